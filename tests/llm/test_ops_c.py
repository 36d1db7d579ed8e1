import itertools
import random
import re

import pytest

from vectrail.llm import op5_ngram_join, op10_decontaminate
from vectrail.llm.components import components, regrouped


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t\n", "a", "A", "a b", "a b c", "b", "a b c d", "A B  c\nd"]
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.choice((5, 12, 40, 120)))]
        for _ in range(random.randint(1, 9)):
            t = list(base)
            for _ in range(random.choice((0, 1, 1, 2, 4))):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t))
    common = " ".join(random.choice(words) for _ in range(60))
    texts += [common + f" x{i}" * random.randint(0, 3) for i in range(40)] + [f"u{i} " * random.randint(1, 9) + common for i in range(20)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_join.groups(df).collect()}
    assert got == brute_groups(texts)


def test_keep_one_and_edges(spark, monkeypatch):
    monkeypatch.setattr(op5_ngram_join, "BROADCAST_IDS", 0)
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, t, 1, 1), (1, t, 2, 2), (2, t + " z", 3, 3), (4, None, 4, 4), (5, "", 5, 5), (6, "other words that stand alone", 6, 6)], "doc_id long, text string, sig int, gram int")
    assert sorted(r.doc_id for r in op5_ngram_join.keep_one(df).collect()) == [1, 4, 5, 6]
    assert op5_ngram_join.groups(df.limit(0)).count() == 0


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(20)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[100 + i] for i in range(1, 20)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = lambda e: spark.createDataFrame(e, "a long, b long")
    steps = {r.node: r.root for r in regrouped(regrouped(components(df(edges[:30])), df(edges[30:60])), df(edges[60:])).collect()}
    assert steps == got


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        dw = words(t)
        for i, x in items:
            iw = words(x)
            w = min(len(iw), op10_decontaminate.WINDOW)
            if not iw:
                continue
            for off in range(-len(iw), len(dw)):
                same = [0 <= off + j < len(dw) and dw[off + j] == iw[j] for j in range(len(iw))]
                seeded = any(all(0 <= p + off + k < len(dw) and same[p + k] for k, c in enumerate(m) if c == "1") and 0 <= p + off and p + off + len(m) <= len(dw) for m in (*op10_decontaminate.MASKS, "1" * len(iw) if len(iw) < 8 else "1" * 99) for p in range(len(iw) - len(m) + 1))
                if seeded and max(sum(same[s : s + w]) for s in range(len(iw) - w + 1)) >= -(-w * 3 // 4):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(op10_decontaminate, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(op10_decontaminate, "BROADCAST_DOCS", limit)
    random.seed(4)
    bag = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(bag) for _ in range(random.choice((3, 9, 20, 40))))) for i in range(12)] + [(90, None), (91, "!!"), (92, "lone")]
    docs = [(i, " ".join(random.choice(bag) for _ in range(random.choice((0, 4, 60))))) for i in range(40)]
    for d in range(40, 90):
        t = random.choice(items[:12])[1].split()
        for _ in range(len(t) // 6):
            t[random.randrange(len(t))] = "subst"
        docs.append((d, "Before, " * random.randint(0, 9) + " ".join(t) + " after."))
    docs += [(95, None), (96, ""), (97, "x " * 500 + items[11][1].upper())]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    bb = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, int(i)) for r in op10_decontaminate.contaminated(dd, bb).collect() for i in r.item_ids.split(",")}
    assert got == brute_leaks(docs, items)
    left = {r.doc_id for r in op10_decontaminate.decontaminate(dd, bb).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert op10_decontaminate.contaminated(dd.limit(0), bb).count() == 0 and op10_decontaminate.contaminated(dd, bb.limit(0)).count() == 0


def test_masks_leave_no_pattern_out():
    for n in range(1, op10_decontaminate.WINDOW + 1):
        masks = op10_decontaminate.MASKS if n >= op10_decontaminate.SHORT else op10_decontaminate.short_masks(n)
        at = [{p + i for i, c in enumerate(m) if c == "1"} for m in masks for p in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - -(-n * 3 // 4)):
            assert any(not a & set(gone) for a in at), (n, gone)


def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            dw, iw = words(t), words(x)
            w = min(len(iw), op10_decontaminate.WINDOW)
            for off in range(-len(iw), len(dw)):
                same = [0 <= off + j < len(dw) and dw[off + j] == iw[j] for j in range(len(iw))]
                if max(sum(same[s : s + w]) for s in range(len(iw) - w + 1)) >= -(-w * 3 // 4):
                    out.add((d, i))
    return out


def test_leaks_with_replaced_words(spark):
    random.seed(6)
    bag = [f"w{i}" for i in range(50)]
    items = [(n, " ".join(random.choice(bag) for _ in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 15, 30)]
    texts = []
    for n, x in items:
        w = x.split()
        texts += [" ".join("new" if i % step == phase else v for i, v in enumerate(w)) for step in (3, 4, 5) for phase in range(step)]
        for _ in range(12):
            gone = random.sample(range(n), min(n, random.choice((n // 4, n // 5, n // 4 + 1))))
            texts.append("so " * random.randint(0, 2) + " ".join("new" if i in gone else v for i, v in enumerate(w)) + " end" * random.randint(0, 1))
            texts.append(" ".join(w[random.randrange(3) :]))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, int(i)) for r in op10_decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect() for i in r.item_ids.split(",")}
    assert got == plain_leaks(docs, items)
