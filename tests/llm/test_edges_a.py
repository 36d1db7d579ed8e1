"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns of operators 2, 3, 4 and 7."""

import random

import zlib

import numpy as np
import pyarrow as pa
import pytest


from vectrail.llm import op2_license_scan, op3_quality, op4_token_codes, op7_pii, tokens
from vectrail.llm.common import shared_folder, word_hash

DOCS = "doc_id long, text string"


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_word_hash_tells_words_apart():
    words = [thue_morse(10).encode(), thue_morse(10).translate(str.maketrans("ab", "ba")).encode(), b"", b"a", b"a\0", b"x" * 256, b"x" * 257, b"x" * 258, b"y" + b"x" * 256]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    data = np.frombuffer(b"".join(words), np.uint8)
    assert len(set(word_hash(data, starts, ends).tolist())) == len(words)
    assert (word_hash(data, starts, ends) != word_hash(data, starts, ends, 1)).all()
    twice = np.frombuffer(b"..some words, long enough|some words, long enough", np.uint8)
    h = word_hash(twice, np.array([2, 25 + 0]), np.array([24, 47]))
    assert h[0] == h[1] if bytes(twice[2:24]) == bytes(twice[25:47]) else h[0] != h[1]


def test_token_ids_equal_the_library():
    enc = tokens.encoder()
    random.seed(3)
    t = thue_morse(10)
    texts = [t, t.translate(str.maketrans("ab", "ba")), t, None, "", "中文字 привет " * 40, "<|endoftext|>"]
    bag = "ab cé\n\t.,1 ß÷×Ã漢 '-_ZQ"
    texts += ["".join(random.choice(bag) for _ in range(random.randint(0, 50))) for _ in range(4000)]
    got = [ids[bounds[k] : bounds[k + 1]] for _, ids, bounds in tokens.encode_column(pa.array(texts)) for k in range(len(bounds) - 1)]
    assert all(np.array_equal(a, b) for a, b in zip(got, enc.whole([x or "" for x in texts]), strict=True))


def test_small_memory_of_units(monkeypatch):
    """Units push each other out of a small table, and the pool runs over."""
    monkeypatch.setattr(tokens, "SLOTS_LOG2", 4)
    monkeypatch.setattr(tokens, "POOL", 60)
    monkeypatch.setattr(tokens, "GROUP", 7)
    enc = tokens.UnitEncoder(tokens.default_path())
    random.seed(4)
    for _ in range(60):
        texts = [" ".join(random.choice(("one", "two", "three", "a-b", "42,", "extraordinarily")) for _ in range(random.randint(0, 40))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, bounds = enc.encode(np.frombuffer(b"".join(raw), np.uint8), cuts)
        for k, want in enumerate(enc.whole(texts)):
            assert np.array_equal(ids[bounds[k] : bounds[k + 1]], want)


def test_token_files_are_read_by_place(spark):
    random.seed(5)
    rows = [(i * 3, " ".join(random.choice(("alpha", "beta", "gamma,", "1234567", "été")) for _ in range(random.choice((0, 3, 400))))) for i in range(40)]
    rows += [(None, "no id"), (9, "again"), (30, None), (999, "long " * 300_000)]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], DOCS + ", part int, seq string, n_ids int")
    path = shared_folder(spark, "test-codes")
    op4_token_codes.write_token_files(df.repartition(5), path, shard_ids=3000)
    enc = tokens.encoder()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*enc.whole([t or ""])[0].tolist(), 2])
    got = op4_token_codes.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    files = op4_token_codes.TokenFiles(spark, path)
    assert len(files) == sum(r.n_tokens for r in got) and len(files.names) > 1
    flat = []
    for r in got:
        match = [x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and len(x) == r.n_tokens]
        assert match and r.start == len(flat)
        flat += match[0]
    for position in [0, 1, len(flat) - 1, *random.sample(range(len(flat)), 40)]:
        before = files.bytes_read
        assert files.token(position) == flat[position]
        assert files.bytes_read - before <= 3 * (1 + 64 + 4) + 24 + 3 * 24  # three levels, and a header at first
    before = files.bytes_read
    assert files.token(len(flat) - 2) == flat[-2] and files.bytes_read - before <= 300
    starts = {r.doc_id: r.start for r in reversed(got)}
    for doc_id in (0, 30, 999, None, 117):
        assert files.lookup(doc_id, 0) == flat[starts[doc_id]]
    before = files.bytes_read
    assert files.lookup(999, 250_000) == flat[starts[999] + 250_000] and files.bytes_read - before < 1500
    with pytest.raises(KeyError):
        files.lookup(10_000, 0)
    with pytest.raises(IndexError):
        files.token(len(flat))
    files.close()


NUMBERS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
LOOKS = dict(zip("aceopxyiB", "асеорхуіВ", strict=True))


def disguise(kind, value, rng):
    """The value in several disguises at once, and what a plain reading of it would be."""
    at, dot = rng.choice(["@", " [at] ", " ( at ) ", "［at］", " [аt] ", "＠", "&#64;", "&commat;"]), rng.choice([".", " [dot] ", " (dot) ", "．", "&#46;"])
    if kind == "email":
        local, host = value.split("@")
        text = local + at + host.replace(".", dot)
        letters = [LOOKS.get(c, c) if rng.random() < 0.2 and c in LOOKS else c for c in local]
        return "".join(letters) + text[len(local) :]
    if kind in ("card", "phone"):
        groups = value.split(" ")
        return " ".join(" ".join(NUMBERS[c] for c in g) if rng.random() < 0.5 and g.isdigit() else "".join(chr(ord(c) + 0xFEE0) if rng.random() < 0.2 and c.isdigit() else c for c in g) for g in groups)
    return value.replace(".", rng.choice([" dot ", " [dot] ", "．", "."])) if rng.random() < 0.7 else " dot ".join(" ".join(NUMBERS[c] for c in g) for g in value.split("."))


def test_disguises_composed_against_what_was_hidden():
    rng = random.Random(7)
    values = [("email", "jane.doe@mail.example.com"), ("email", "bob@x.org"), ("card", "4111 1111 1111 1111"), ("phone", "+1 212 555 0100"), ("ip", "192.168.1.20")]
    for _ in range(600):
        kind, value = rng.choice(values)
        hidden = disguise(kind, value, rng)
        if kind == "email" and (" [" in hidden) + (" (" in hidden) and "@" not in hidden and hidden.count("at") == 0 and "аt" not in hidden:
            continue
        text = f"See: {hidden}; thanks."
        base, added = op7_pii.find(text)
        spans = [(op7_pii.KINDS[k], text[a:b]) for a, k, b in base + added]
        # A plain identifier may be a part of the disguised one, and stays beside it.
        assert (kind, hidden) in spans and all(k == kind and x in hidden for k, x in spans), (text, spans)
        assert op7_pii.mask(text) == f"See: [{kind.upper()}]; thanks."


@pytest.mark.parametrize("text,part", [("jane [аt] mail.com", "jane [аt] mail.com"), ("jane［at］mail.com", "jane［at］mail.com"), ("jane at mail.com now", "jane at mail.com"), ("mail jane &#64; x.com", "jane &#64; x.com")])
def test_disguises_in_disguised_marks(text, part):
    base, added = op7_pii.find(text)
    assert base == [] and [text[a:b] for a, _, b in added] == [part]


def test_hints_leave_nothing_out(monkeypatch):
    """Texts without a hint are not read by the second transducer: it would not have changed the result."""
    rng = random.Random(8)
    bag = ["at", "AT", " ", "  ", "\t", "dot", "Dot", "[", "]", "(", ")", "@", ".", "com", "x", "mail", "plus", "+", "1", "555", "one", "ſeven", "Two", ", ", "-", "é", "ａ", "&#64;", "K", "192", "of", "ß"]
    texts = ["".join(rng.choice(bag) for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    texts += [" ".join(["ſeven one two five five five oh one oh oh"]), "+ ſix one two five five five oh one oh oh", "x@mail.com at y.com", "jane AT mail.COM"]
    quick = [op7_pii.find(t) for t in texts]
    monkeypatch.setattr(op7_pii, "hints", lambda text: (True, True))
    assert [op7_pii.find(t) for t in texts] == quick and sum(len(a) for _, a in quick) > 50


def test_plain_prose_is_left_alone():
    for text in ("look at example.com", "We met at noon. It was at home.then we left", "available at shop.example.com today", "one day, two of us", "a & b &#8364; c", "the dot at the end", "&#1114112; &#0; &#xD800;"):
        assert op7_pii.find(text) == ([], [])


def test_pii_edges(spark):
    texts = ["0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", "4" * 100_000, "+" * 50_000, "@" * 50_000, "a@" * 50_000, "one " * 50_000, "at dot " * 30_000, "&#" * 50_000, "а" * 100_000]
    for t in texts:
        op7_pii.find(t)
    assert op7_pii.plain_spans(texts[0])[0] == (0, 1, 5006)
    df = spark.createDataFrame([(1, "a@b.co", "k", 1), (1, "a@b.co", "k", 1), (None, None, None, None)], DOCS + ", kind string, start int")
    got = op7_pii.detect(df).collect()
    assert len(got) == 3 and sum(len(r.spans) for r in got) == 2
    again = op7_pii.redact(df)
    assert again.columns == df.columns and sorted(str(r.text) for r in again.collect()) == ["None", "[EMAIL]", "[EMAIL]"]
    assert op7_pii.detect(df.limit(0)).count() == 0 and op7_pii.redact(df.limit(0)).count() == 0


def test_license_edges(spark):
    df = spark.createDataFrame([(1, "Under the MIT license", "x", 1), (1, "Under the MIT license", "x", 1), (None, None, None, None), (2, "word " * 400_000 + "cc by nc", "y", 2)], DOCS + ", labels string, n_words int")
    got = sorted(((r.doc_id or 0, r.n_words, len(r.places)) for r in op2_license_scan.scan(df).collect()))
    assert got == [(0, 0, 0), (1, 4, 1), (1, 4, 1), (2, 400_003, 1)]
    assert op2_license_scan.scan(df.limit(0)).count() == 0


def test_quality_edges(spark):
    rows = [(i, ("good words here. " if i % 2 else "BAD!!! | ") * 20, None if i % 3 else 5, 0.5, i) for i in range(60)]
    schema = DOCS + ", n_chars long, score double, predicted int"
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, None, None, None, None), (99, "word " * 300_000, 1, 1.0, 1)], schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    machine = op3_quality.train(df, labels)
    got = op3_quality.score(df, machine).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    kept = op3_quality.keep_good(df, machine)
    assert kept.columns == df.columns
    assert op3_quality.score(df.limit(0), machine).count() == 0 and op3_quality.keep_good(df.limit(0), machine).count() == 0
    nothing = op3_quality.train(df.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in op3_quality.score(df, nothing).collect())


def test_shared_folder_on_a_cluster(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Cluster, "x")
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

