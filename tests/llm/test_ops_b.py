import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import op1_anisotropic, op6_packing, op8_site_style


def brute_search(rows, k=20):
    out = set()
    for q, a in rows:
        if q % 20 == 0:
            near = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


def test_search_edges(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(i, [0.5] * 6) for i in range(60, 140)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [0.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, rank int")
    got = {tuple(r) for r in op1_anisotropic.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert {g[:3] for g in got} == {w[:3] for w in brute_search(good)}
    few = op1_anisotropic.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2 and op1_anisotropic.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = op1_anisotropic.search(df, F.col("vec_id") % 20 == 0, keep=100).toPandas()
    s = m[::20].astype(np.float64) @ m.T.astype(np.float64)
    s[np.arange(len(s)), np.arange(0, 4000, 20)] = -np.inf
    truth = {(20 * q, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    assert len(truth & set(zip(got.query_id, got.vec_id))) / len(truth) >= 0.9


def test_search_recall_with_near_copies(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(6000, 32))
    m[::3] = m[0] + 0.01 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = op1_anisotropic.search(df, F.col("vec_id") % 20 == 0).toPandas()
    s = m[::20] @ m.T
    s[np.arange(len(s)), np.arange(0, 6000, 20)] = -np.inf
    truth = {(20 * q, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    found = truth & set(zip(got.query_id, got.vec_id))
    crowd = {t for t in truth if t[0] % 60 == 0}
    print("recall", len(found) / len(truth), len(found & crowd) / len(crowd))
    assert len(got) == len(truth) and len(found) / len(truth) >= 0.9 and len(found & crowd) / len(crowd) >= 0.9


def test_boundaries_are_optimal():
    random.seed(1)
    pad = lambda edges, h: sum(c * (min(e for e in edges if e >= n) - n) for n, c in h.items())
    for _ in range(60):
        h = {random.randint(1, 30): random.randint(1, 9) for _ in range(random.randint(1, 9))}
        k = random.randint(1, 4)
        want = min(pad(c, h) for r in range(1, k + 1) for c in itertools.combinations(sorted(h), min(r, len(h))) if max(c) == max(h))
        got = op6_packing.boundaries(h, k)
        assert len(got) <= k and pad(got, h) == want
    assert op6_packing.boundaries({}) == []


def test_packing(spark):
    random.seed(2)
    sizes = [random.randint(1, 90) for _ in range(300)] + [1000, 0]
    df = spark.createDataFrame([(i % 290, n) for i, n in enumerate(sizes)] + [(None, 7)], "doc_id long, n_tokens long")
    rows = op6_packing.pack(df, max_length=64, buckets=4, budget=256, part_rows=50).collect()
    assert sum(r.n_tokens for r in rows) == sum(sizes) + 7 and len({r.boundary for r in rows}) <= 4
    batches = {}
    for r in rows:
        assert 0 < r.n_tokens <= r.boundary and r.padding == r.boundary - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), rs in batches.items():
        assert len(rs) * rs[0].boundary <= 256 and sorted(r.slot for r in rs) == list(range(len(rs)))
    for b in {k[0] for k in batches}:
        full = 256 // next(r.boundary for r in rows if r.bucket == b)
        assert sum(len(rs) < full for (k, _), rs in batches.items() if k == b) <= 1
    assert op6_packing.pack(df.limit(0)).count() == 0


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in op6_packing.token_lengths(df).collect()} == {1: 1, 2: 1, 3: 3}


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Home</a></ul></nav><div class=box>Same words everywhere</div><!-- c --><div class='ad'>Buy {0}</div><article><h1>Title {0}</h1><p><b>First &amp; {0}<br><p>Second\n  part {0}</p></article><section id=comments>nice {0}</section><footer>&copy; us</footer></body></html>"


def test_extract(spark, tmp_path):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"w{i}")) for i in range(12)]
    rows += [(100, "http://one.example/", "<p>Alone &lt;b&gt;<p>two<div>three</div>"), (101, None, None), (102, "http://[bad", ""), (103, "http://one.example/", "no tags at all"), (104, "u", "<a \"" * 1000 + "<p>x")]
    rows += [(200 + i, "https://plain.example/", f"<body><div><span>Menu</span></div><div class=c><p>Unique story {i}</p><p>more of {i}</p></div><div class=f>All rights of this site</div></body>") for i in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op8_site_style.op8_site_style(spark, str(tmp_path)).collect()}
    assert got[3].text == "Title w3\n\nFirst & w3\n\nSecond part w3" and got[3].n_chars == len(got[3].text)
    assert got[100].text == "Alone <b>\n\ntwo\n\nthree" and got[101].text == got[102].text == "" and got[103].text == "no tags at all"
    assert got[205].text == "Unique story 5\n\nmore of 5"


@pytest.mark.parametrize("limit", [0])
def test_extract_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(op8_site_style, "BROADCAST_PATHS", limit)
    rows = [(i, "http://h.example/", PAGE.format(f"w{i}").replace("article", "div")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op8_site_style.extract(df).collect()}
    assert got[3] == "Title w3\n\nFirst & w3\n\nSecond part w3"


def test_extract_mirrored_pages(spark):
    rows = [(i, f"http://mirror.example/{i}", PAGE.format("same")) for i in range(10)]
    rows += [(20 + i, f"http://lines.example/{i}", f"<body><p>Motto</p><article><h2 class=x>Summary</h2><p>Story {i}</p></article></body>") for i in range(10)]
    rows += [(40 + i, f"http://plain.example/{i}", f"<body><div class=c><p>One story</p></div><nav><a>{i}</a></nav></body>") for i in range(10)]
    rows += [(60 + i, f"http://styled.example/{i}", f"<body><div class=c><p>One story</p></div><nav class=n{i}><a>{i}</a></nav><div class='nav k{i}'><i></i></div><hr class=h{i}></body>") for i in range(10)]
    got = {r.page_id: r.text for r in op8_site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title same\n\nFirst & same\n\nSecond part same"
    assert got[23] == "Summary\n\nStory 3"
    assert got[43] == got[63] == "One story"
