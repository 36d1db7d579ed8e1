"""Edges of operators 1, 5, 6, 8, 9 and 10 and the whole pipeline against plain versions."""

import hashlib
import math
import random
import re


import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectrail.llm import op1_anisotropic, op3_quality, op5_ngram_join, op6_packing, op7_pii, op8_site_style, op10_decontaminate
from vectrail.llm import op9_suffix_dedup as op9
from vectrail.llm.components import components, least_labels

DOCS = "doc_id long, text string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_groups(rows, n=4, num=85, den=100):
    """The smallest id of each row's group, by position."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


@pytest.mark.parametrize("n", [4, 5])
@pytest.mark.parametrize("texts", [["a b"], ["a", "b"], ["", "x y", ""], ["a b c"], ["a b c d"], [None], ["a b c d e", "a b"]])
def test_runs_of_few_words(spark, n, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_join.groups(df, n).collect()}
    root, sets = brute_groups(list(enumerate(texts)), n)
    assert got == {i: (len(sets[i]), min(j for j in range(len(texts)) if root[j] == root[i])) for i in range(len(texts))}


def test_batch_that_ends_with_two_words(spark):
    df = spark.range(10_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 10_000, "last words").otherwise(F.concat_ws(" ", F.lit("text number"), "id", F.lit("of many"))).alias("text")).coalesce(1)
    got = op5_ngram_join.groups(df)
    assert got.count() == 10_001 and got.where("component_id = doc_id").count() == 10_001


def test_words_that_a_weak_hash_confuses(spark):
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, t), (2, t.translate(str.maketrans("ab", "ba"))), (3, t)], DOCS)
    assert {r.doc_id: r.component_id for r in op5_ngram_join.groups(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_two_sets_of_one_name_are_named_anew(spark, monkeypatch):
    real = op5_ngram_join.set_hash

    def weak(rows, grams, n, salt=0):
        size, sig = real(rows, grams, n, salt)
        return (size, sig & 1) if not salt and len(grams) and n < 100 and weak.on else (size, sig)

    weak.on = True
    described = op5_ngram_join.describe
    calls = []

    def counted(docs, n, salt=0):
        calls.append(salt)
        out = described(docs, n, salt)
        return out.withColumn("sig", F.col("sig") % 2) if not salt else out

    monkeypatch.setattr(op5_ngram_join, "describe", counted)
    df = spark.createDataFrame([(i, f"text {i} is one of its own kind") for i in range(6)], DOCS)
    rows, salt = op5_ngram_join.described_rows(df, 4)
    assert salt == 1 and calls == [0, 1] and rows.select("sig").distinct().count() == 6


@pytest.mark.parametrize("tile", [3, 7])
def test_common_grams_in_small_tiles(spark, monkeypatch, tile):
    """Large groups of near copies and common passages, with tiles, chunks and memories so small that every way is taken."""
    for name, value in (("TILE", tile), ("COMMON", 2), ("CHUNK_GRAMS", 500), ("RANGE_GRAMS", 200), ("REMEMBERED", 5), ("BROADCAST_IDS", 3), ("NEAREST", 1)):
        monkeypatch.setattr(op5_ngram_join, name, value)
    random.seed(tile)
    words = [f"w{i}" for i in range(30)]
    base = [random.choice(words) for _ in range(45)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(random.choice((0, 1, 1, 2, 3))):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:12] + [random.choice(words) for _ in range(random.choice((3, 20)))])) for i in range(30)]
    rows += [(200, rows[0][1]), (201, rows[0][1].upper()), (None, rows[3][1])]
    root, sets = brute_groups(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(3).cache()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_join.groups(df).collect()}
    want = {d: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None)) for i, (d, _) in enumerate(rows)}
    assert got == want
    kept = sorted(r.doc_id for r in op5_ngram_join.keep_one(df).collect())
    assert kept == sorted({c for _, c in want.values()})


def stages(spark):
    """Rows that each of the last stages wrote for a shuffle."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(found.size())}


@pytest.mark.parametrize("bound", [200_000, 2])
def test_verifying_few_pairs_moves_few_sets(spark, monkeypatch, bound):
    monkeypatch.setattr(op5_ngram_join, "BROADCAST_IDS", bound)
    grams = [np.arange(100 * i, 100 * i + 20, dtype=np.uint64) for i in range(3000)]
    grams[1] = np.append(grams[0][:19], grams[1][:1])
    rows = [(i, 20, bytearray(g.tobytes())) for i, g in enumerate(grams)]
    sets = op5_ngram_join.written(spark.createDataFrame(rows, "sig long, size long, grams binary"), "sets")
    pairs = op5_ngram_join.written(spark.createDataFrame([(0, 1), (0, 2), (7, 2900)], "a long, b long"), "pairs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages(spark)
        got = op5_ngram_join.verify(sets, pairs, 85, 100).collect()
        moved = sum(n for k, n in stages(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [tuple(r) for r in got] == [(0, 1)]
    assert moved < 50 or bound == 2


def test_suffix_filter_bounds_hold():
    """No pair that is similar is dropped, by any of its common grams."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        universe = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
        rank = rng.permutation(len(universe))
        a = rng.random(len(universe)) < 0.7
        b = a ^ (rng.random(len(universe)) < 0.12)
        sets = [universe[m][np.argsort(rank[m])] for m in (a, b)]
        size = np.array([len(x) for x in sets])
        if not size.min():
            continue
        shared = len(np.intersect1d(*sets))
        if 100 * shared < 85 * (size.sum() - shared):
            continue
        many = size - -(-85 * size // 100) + 1
        firsts = np.cumsum(size) - size
        tail = op5_ngram_join.tails(np.repeat([0, 1], size), np.concatenate(sets), 2, firsts, many).view(np.uint8).reshape(-1, op5_ngram_join.PARTS).astype(np.int16)
        parity = np.stack([np.frombuffer(p, np.uint64) for p in op5_ngram_join.parities(np.repeat([0, 1], size), np.concatenate(sets), 2)])
        order = np.argsort(size, kind="stable")
        met = False
        for g in np.intersect1d(*(x[:m] for x, m in zip(sets, many, strict=True))):
            pos = np.array([int(np.nonzero(x == g)[0][0]) for x in sets])
            t = np.stack([tail[pos[0]], tail[many[0] + pos[1]]])
            cols = [np.array([1, 2]), size, pos, np.zeros(2, int), np.array([1, 2]), np.zeros(2, int), t, parity]
            j, need, most = op5_ngram_join.likely([c[order] for c in cols], op5_ngram_join.ALL, 0, 85, 100)
            assert len(j) == 1 and most[0] >= shared
            met = True
        assert met


def test_keep_one_takes_rows_not_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t, 1), (7, t + " z", 2), (7, "a text of its own that nothing resembles", 3), (3, t, 4), (None, t, 5), (None, "without an id but alone in the table", 6), (8, None, 7), (8, None, 8)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], DOCS + ", mark int, _gone int, root int, best int")
    got = [(r.doc_id, r.text) for r in op5_ngram_join.keep_one(df).collect()]
    assert op5_ngram_join.keep_one(df).columns == df.columns
    assert sorted(map(str, got)) == sorted(map(str, [(3, t), (7, rows[2][1]), (None, rows[5][1]), (8, None), (8, None)]))
    assert op5_ngram_join.keep_one(df.limit(0)).count() == 0


def test_very_long_text_has_near_copies(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50:])), (3, " ".join(reversed(words))), (4, "x" * 2_000_000)]
    got = {r.doc_id: r.component_id for r in op5_ngram_join.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_labels_of_edges(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, (2, 260))
    nodes, root = least_labels(a, b)
    parent = {int(x): int(x) for x in nodes}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = sorted((top(x), top(y)))
        parent[q] = p
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {i: top(i) for i in parent}
    many = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").repartition(6)
    for rows in (260, 400_000):  # one part, and several with star steps between them
        got = {r.node: r.root for r in components(many, rows).collect()}
        assert got == {i: top(i) for i in parent if top(i) != i}


def brute_removed(rows):
    """(bytes, removed, spans, digest) of each row; rows in the order of their ids."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("big", [3, 8000])
def test_one_gram_in_most_texts(spark, monkeypatch, big):
    """A line that most texts hold, with the dealing out of large buckets, tiny batches and a tiny memory."""
    monkeypatch.setattr(op9, "BIG", big)
    monkeypatch.setattr(op9, "CONTEXTS", 10)
    monkeypatch.setattr(op9, "REMEMBERED_LOG2", 3)
    monkeypatch.setattr(op9, "CHUNK", 700)
    random.seed(11)
    line = "this very common line of text stands in most of all the documents there are"
    word = lambda: "".join(random.choice("abcde") for _ in range(random.randint(1, 6)))
    around = ["".join(word() + " " for _ in range(12)) for _ in range(6)]
    texts = []
    for _ in range(80):
        left, right = random.choice([*around, word() * 20]), random.choice([*around, word() * 20])
        texts.append(left[random.randint(0, 20) :] + line + right[: random.randint(0, 60)])
    texts += [line * 3, around[0] * 4, random.choice(texts), random.choice(texts), "é" * 300, "a" * 5000, ("ab" * 60 + "c") * 30]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in op9.remove(df).collect()}
    want = brute_removed(rows)
    assert {i: g for i, g in got.items() if g != want[i]} == {} and len(got) == len(rows)


def test_repeats_in_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    part = long[300_000:300_400]
    rows = [(1, long), (2, "x" + part + "y"), (3, long[5:] + "end"), (4, part[:120])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in op9.remove(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (0, 0), 2: (400, 1), 3: (len(long) - 5, 1), 4: (120, 1)}


def test_string_buckets_against_slices():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[400:700] = data[:300]
    cuts = np.array([300, 650, 900])
    room = cuts[np.searchsorted(cuts, np.arange(900), "right")] - np.arange(900)
    for length in (8, 13, 16, 50, 100):
        got = op9.string_buckets(data, room, length)
        names = {}
        want = [names.setdefault(data[i : i + length].tobytes(), len(names)) if room[i] >= length else -1 for i in range(900)]
        assert [(g >= 0) for g in got] == [w >= 0 for w in want]
        pairs = {(int(g), w) for g, w in zip(got, want, strict=True) if w >= 0}
        assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def plain_page(i, rng, article="div", nav="div", words=60):
    text = " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(1000)) for _ in range(words))
    half = text[: len(text) // 2].rsplit(" ", 1)[0]
    rest = text[len(half) + 1 :]
    menu = "".join(f"<li><a href=/{k}>go{rng.randrange(50)}</a>" for k in range(rng.randint(2, 5)))
    html = f"<html><body><{nav}><ul>{menu}</ul></{nav}><div>Offer {rng.randrange(10**6)} now</div><{article}><h1>Story {i}</h1><p>{half}<p>{rest}</{article}><div>(c) {i} this site</div></body></html>"
    return html, f"Story {i}\n\n{half}\n\n{rest}"


def test_tree_decides_without_marks(spark):
    """Pages without article elements, marked classes or roles: advertisements and footers differ from page to page."""
    rng = random.Random(4)
    made = [plain_page(i, rng) for i in range(30)]
    rows = [(i, f"https://site{i % 3}.example/{i}", h) for i, (h, _) in enumerate(made)]
    # A host of one page leans on what the same nodes are like elsewhere.
    made.append(plain_page(30, rng))
    rows.append((30, "https://alone.example/", made[30][0]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op8_site_style.extract(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(made)}
    without = {i: op8_site_style.main_text(op8_site_style.Page(h), frozenset()) for i, h in ((r[0], r[2]) for r in rows)}
    assert all(without[i] != got[i] for i in got)


def test_tree_against_a_plain_reading_of_marked_pages(spark):
    """The same pages with article and nav elements give the same texts."""
    rng = random.Random(5)
    made = [plain_page(i, rng, "article", "nav") for i in range(12)]
    df = spark.createDataFrame([(i, "https://marked.example/", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in op8_site_style.extract(df).collect()} == {i: want for i, (_, want) in enumerate(made)}


def test_compound_class_names_are_no_marks(spark):
    body = ["<article class='post comments-open'><p>Open text</p></article>", "<div id=page class=has-sidebar><article><p>Side text</p></article></div>", "<article><div class=article-header><h1>Title</h1></div><p>Body</p></article>", "<article><p>One</p><p class=share-price>Price</p></article>", "<article><p>Text</p><div class=comments><p>nice</p></div><div class='ad x'>buy</div></article>"]
    df = spark.createDataFrame([(i, f"https://h{i}.example", f"<body>{b}</body>") for i, b in enumerate(body)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op8_site_style.extract(df).collect()}
    assert got == {0: "Open text", 1: "Side text", 2: "Title\n\nBody", 3: "One\n\nPrice", 4: "Text"}


def test_both_branches_read_odd_addresses_alike(spark, monkeypatch):
    rng = random.Random(6)
    urls = ["//odd.example/x", "http://[bad", "  https://ODD.example/y", None, "", "odd.example", "https://odd.example:8080/z", "ftp://odd.example"]
    rows = [(i, urls[i % len(urls)], plain_page(i, rng)[0], "low", "host") for i in range(40)] + [(0, urls[0], None, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low string, host string")
    few = sorted(map(str, op8_site_style.extract(df).collect()))
    monkeypatch.setattr(op8_site_style, "BROADCAST_PATHS", 0)
    assert sorted(map(str, op8_site_style.extract(df).collect())) == few and len(few) == 41
    assert op8_site_style.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", ['<a "' * 250_000, "<div>" * 100_000 + "</i>" * 100_000, "<i>" + "<div>" * 80_000 + "</i>" * 80_000, "<p><div>" + "<center>" * 60_000 + "<hr>" * 60_000, '<a b="> c="' * 90_000, "<div>x" * 120_000, "<table>" + "<td>x" * 100_000, "<!--" * 200_000, "&am" * 300_000])
def test_pages_of_a_megabyte_are_linear(source):
    import time

    began = time.time()
    op8_site_style.Page(source)
    assert time.time() - began < 5


def test_search_of_long_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 700))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000, m[0][:5].tolist()), (1020, None)]
    df = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "vec_id long, embedding array<double>, score double, query_id int")
    got = op1_anisotropic.search(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    s = m[::20] @ m.T
    s[np.arange(len(s)), np.arange(0, 300, 20)] = -np.inf
    assert {(r.query_id, r.vec_id) for r in got.itertuples()} == {(20 * q, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:5]}


def test_search_in_several_shares(spark, monkeypatch):
    monkeypatch.setattr(op1_anisotropic, "SHARE_BYTES", 2000)
    monkeypatch.setattr(op1_anisotropic, "SCAN_ROWS", 64)
    monkeypatch.setattr(op1_anisotropic, "QUERY_ROWS", 7)
    rng = np.random.default_rng(10)
    m = rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = op1_anisotropic.search(df, F.col("vec_id") % 20 == 0, keep=40).toPandas()
    s = m[::20] @ m.T
    s[np.arange(len(s)), np.arange(0, 1500, 20)] = -np.inf
    truth = {(20 * q, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    assert len(truth & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.95 * len(truth) and len(got) == len(truth)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 0, 1), (3, -5, 1), (None, 7, 1), (4, 5000, 1), (4, 5000, 1), (4, 10, 1), (4, 9, 1)], "doc_id long, n_tokens long, bucket int")
    rows = op6_packing.pack(df).collect()
    assert sum(r.n_tokens for r in rows) == 7 + 5000 + 5000 + 19 and all(r.n_tokens > 0 for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)


def test_leaks_of_repeated_words_and_rows(spark):
    item = "the " * 20
    docs = [(1, "the " * 3000), (2, "no such words here at all, none of them is"), (2, "x " + item), (2, "x " + item), (None, item), (5, None), (6, "")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS + ", _leak_key int, offset int, h int")
    bench = spark.createDataFrame([(7, item, 1), (8, "other words that are in no document of this table at all", 1), (None, "the the the the", 1), (9, None, 1)], "item_id long, text string, seed int")
    got = sorted((r.doc_id or 0, r.item_ids, r.best) for r in op10_decontaminate.contaminated(df, bench).collect())
    assert got == [(0, "7", 1.0), (1, "7", 1.0), (2, "7", 1.0), (2, "7", 1.0)]
    left = op10_decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [docs[1], docs[5], docs[6]]))
    assert op10_decontaminate.decontaminate(df.limit(0), bench).count() == 0


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def leaks_plainly(text, item):
    dw, iw = words(text), words(item)
    w = min(len(iw), op10_decontaminate.WINDOW)
    for off in range(-len(iw), len(dw)):
        same = [0 <= off + j < len(dw) and dw[off + j] == iw[j] for j in range(len(iw))]
        if max(sum(same[s : s + w]) for s in range(len(iw) - w + 1)) >= -(-w * 3 // 4):
            return True
    return False


def test_run_against_a_plain_version(spark, tmp_path):
    """run() on a small corpus against its stages in plain Python; scores of the classifier come from its own kernel."""
    rng = random.Random(12)
    bag = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "nim", "dor")]
    text = lambda n: " ".join(rng.choice(bag) for _ in range(n)) + "."
    good = [text(rng.choice((30, 80, 200))) for _ in range(120)]
    leak = text(40)
    texts = [*good, *(x.upper().replace(" ", "!! ") for x in good[:40])]
    for _ in range(25):
        w = rng.choice(good).split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [text(30) + " " + leak, text(20) + " " + leak.replace("ren", "ran", 1), "mail me at jane@mail.example.com " + text(60), "call +1 (212) 555-0100 " + text(50), None, "", "one two"]
    rows = [(i * 2, t, "en", "s", None if t is None else len(t), "extra", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long, sig string, batch int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(2 * i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    machine = op3_quality.train(docs, labels)
    accepted = {r.doc_id for r in op3_quality.score(docs, machine).where("predicted = 1").collect()}
    state = [(r[0], r[1]) for r in rows if r[0] in accepted]
    root, sets = brute_groups(state, 5, 80, 100)
    least = {}
    for (d, _), r in zip(state, root, strict=True):
        least[r] = min(d, least.get(r, d))
    state = [(d, t) for (d, t), r, s in zip(state, root, sets, strict=True) if not s or least[r] == d]
    state = [(d, t) for d, t in state if not leaks_plainly(t, leak)]
    state = [(d, op7_pii.mask(t)) for d, t in state]
    from vectrail.llm.tokens import encoder

    sizes = {d: len(encoder().whole([t or ""])[0]) + 1 for d, t in state}
    want = sorted((d, p, p * op6_packing.MAX_LENGTH, min(op6_packing.MAX_LENGTH, n - p * op6_packing.MAX_LENGTH)) for d, n in sizes.items() for p in range(math.ceil(n / op6_packing.MAX_LENGTH)))
    assert sorted((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
    edges = op6_packing.boundaries({n: sum(x[3] == n for x in want) for n in {x[3] for x in want}})
    assert all(r.boundary == min(e for e in edges if e >= r.n_tokens) for r in got)
    assert len(want) > 60 and len(accepted) < len(rows)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
