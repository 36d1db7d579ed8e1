import hashlib
import random

import pytest

import corpus_pipeline
from vectrail.llm import op9_suffix_dedup as op9


def brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_removal_against_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(op9, "BROADCAST_SPANS", limit)
    random.seed(6)
    word = lambda: random.choice(["the", "é", "und"]) if random.random() < 0.5 else "".join(random.choice("abcdef") for _ in range(random.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (20, 30, 60)]
    texts = [None, "", "x", "a" * 99, "a" * 100, "a" * 101, "a" * 1000, "ab" * 300, "y" * 50 + "a" * 130]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 3))]
        for _ in range(random.randint(0, 2)):
            p = random.choice(passage)
            parts.insert(random.randint(0, len(parts)), p[random.randint(0, 20) : len(p) - random.randint(0, 20)])
        texts.append("".join(parts))
    texts += random.choices(texts[9:], k=12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute(texts)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(texts)


def test_removal_edges(spark):
    t = "some text that is long enough to hold a string of one hundred bytes and a little more than that, yes indeed it is"
    df = spark.createDataFrame([(5, t, 1), (5, t, 2), (None, t, 3), (6, t + " more", 4), (7, None, 5)], "doc_id long, text string, start int")
    got = sorted((r.doc_id or 0, r.n_removed) for r in op9.remove(df).collect())
    assert got == [(0, 0), (5, len(t)), (5, len(t)), (6, len(t)), (7, 0)]
    assert op9.remove(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    random.seed(9)
    bag = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "nim", "dor")]
    text = lambda n: " ".join(random.choice(bag) for _ in range(n)) + "."
    good = [text(80) for _ in range(200)]
    leak = text(40)
    rows = [*good, *(x.upper().replace(" ", "!! ") for x in good[:60]), good[0] + " end", text(30) + " " + leak, "mail me at jane@mail.example.com " + text(60), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "personal_data", "packing"]
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        state.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert state.columns == docs.columns
            seen.append({r.doc_id: r.text for r in state.collect()})
    assert set(range(200)) <= set(seen[0]) and not set(range(200, 260)) & set(seen[0])
    assert 260 not in seen[1] and set(range(200)) <= set(seen[1]) and 261 in seen[1]
    assert 261 not in seen[2] and set(range(200)) <= set(seen[2])
    assert seen[3][262].startswith("mail me at [EMAIL] ") and seen[3][0] == good[0]
    assert {r.doc_id for r in state.collect()} == set(seen[3])
