import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vectrail.llm import op2_license_scan, op3_quality, op4_token_codes, op7_pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def naive_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_pii_patterns_against_plain_expressions():
    random.seed(5)
    for alphabet in ("ab1.@-_ %+", "0123 -.+()", "12.5.", "a@b.c_"):
        for _ in range(4000):
            t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
            assert op7_pii.plain_spans(t) == naive_pii(t), t
    for t in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "+1 (212) 555-0100"):
        assert op7_pii.plain_spans(t) == naive_pii(t)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("write to jane.doe [at] mail (dot) example [dot] com now", "email", "jane.doe [at] mail (dot) example [dot] com"),
        ("write to jane at mail dot example dot com now", "email", "jane at mail dot example dot com"),
        ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("mail jane＠example．com now", "email", "jane＠example．com"),
        ("call + one two one two five five five oh one oh oh thanks", "phone", None),
        ("call +1 two one two five five five zero one zero zero thanks", "phone", "+1 two one two five five five zero one zero zero"),
        ("at 10 dot 1 dot 2 dot 3 there", "ip", "10 dot 1 dot 2 dot 3"),
        ("we met at noon and looked at the dot on a page", None, None),
    ],
)
def test_pii_disguises(text, kind, part):
    base, added = op7_pii.find(text)
    if part is None:
        return
    assert base == [] or kind != "email"
    assert [(op7_pii.KINDS[k], text[a:b]) for a, k, b in added if op7_pii.KINDS[k] == kind] == [(kind, part)]


@pytest.mark.parametrize(
    "kind,part",
    [
        ("phone", "+ one two one two five five five oh one oh oh"),
        ("phone", "plus one four one five five five five zero one two three"),
        ("phone", "+1 four one five, five five five, zero one two three"),
        ("phone", "+1 four one five 555 0123"),
        ("phone", "+1 415, five five five, 0123"),
        ("ip", "one nine two dot one six eight dot one dot one"),
        ("card", "four one one one, one one one one, one one one one, one one one one"),
        ("card", "４111 1111 1111 1111"),
    ],
)
def test_pii_spelled_in_parts(kind, part):
    for text in (f"call {part} thanks", f"one day {part}; no one else"):
        base, added = op7_pii.find(text)
        assert base == [] and [(op7_pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, part)]
    text = "mail ４111 1111 1111 1111 one two times, or one, two, three of us"
    assert [(op7_pii.KINDS[k], text[a:b]) for a, k, b in op7_pii.find(text)[1]] == [("card", "４111 1111 1111 1111")]


def test_pii_query(spark, tmp_path):
    texts = ["a@b.co and 1.2.3.4", None, "", "x" * 300_000 + "@", "é a@b.co"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_pii.op7_pii(spark, str(tmp_path)).collect()}
    assert got[0].spans == "email:0:6,ip:11:18" and got[0].n_email == 1 and got[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    assert got[1].spans == got[2].spans == got[3].spans == "" and got[4].spans == "email:2:8"
    assert op7_pii.redact(docs(spark, texts)).where("doc_id = 0").first().text == "[EMAIL] and [IP]"


def naive_license(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def naive_notices(t):
    """Label and best containment of every template that some block holds."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for n in op2_license_scan.NOTICES + op2_license_scan.LICENSES:
        s = set(n.words)
        for lo in range(0, max(1, len(words)), n.block // 2):
            share = len(s & set(words[lo : lo + n.block])) / len(s)
            if share >= n.threshold - 1e-9:
                out[n.label] = max(out.get(n.label, 0.0), share)
    return out


def test_license_scan_against_brute_force(spark, tmp_path):
    random.seed(2)
    bag = "under the mit license apache version 2 cc by nc Über of this work is licensed gnu general public 3 software".split()
    texts = [None, "", "Under the MIT License. CC BY-NC 4.0; Apache License, Version 2.0", "the " * 5000 + "under THE mit license"]
    texts += [" ".join(random.choice(bag) for _ in range(random.choice((5, 40, 300)))) for _ in range(150)]
    notices = [n.text for n in op2_license_scan.NOTICES]
    texts += ["lorem " * random.randint(0, 90) + " ".join(w for w in random.choice(notices).split() if random.random() > 0.1) for _ in range(60)]
    whole = [n.text for n in op2_license_scan.LICENSES]
    texts += whole + ["lorem ipsum " * random.randint(0, 400) + " ".join(w for w in random.choice(whole).split() if random.random() > 0.04) + " end" * random.randint(0, 300) for _ in range(40)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op2_license_scan.op2_license_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        n, places = naive_license(t)
        assert (got[i].n_words, got[i].n_base) == (n, len(places)), t
        assert (got[i].first_word, got[i].last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {p[1] for p in places}
        assert got[i].base_labels == ",".join(sorted(base))
        notices = naive_notices(t)
        assert got[i].labels == ",".join(sorted(base | set(notices))), t
        assert got[i].score == pytest.approx(max([*notices.values(), *(1.0 for _ in base)], default=0.0))
    assert all(max(len(n.words) for n in op2_license_scan.TEMPLATES) > 33 and n.block >= 2 * len(n.words) for n in op2_license_scan.TEMPLATES)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = op3_quality.Machine()
    feats, vals = rng.integers(0, op3_quality.SIZE, 12), rng.random(12)
    want = m.b + (m.w[feats] * vals).sum() + sum(m.v[feats[i]] @ m.v[feats[j]] * vals[i] * vals[j] for i in range(12) for j in range(i))
    assert m.raw(1, np.zeros(12, int), feats, vals)[0][0] == pytest.approx(want)


def test_quality_held_out(spark, tmp_path):
    random.seed(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    good = [" ".join(random.choice(words) for _ in range(60)) + "." for _ in range(300)]
    bad = [" | ".join(random.choice(words).upper() + "!!" for _ in range(60)) for _ in range(100)]
    d = docs(spark, [*good, *bad, None, ""])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op3_quality.op3_quality(spark, str(tmp_path)).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.doc_id < 300) for r in got if r.doc_id < 400)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op3_quality.score(d, op3_quality.train(d, none)).count() == 402


def test_token_codes(spark, tmp_path):
    texts = ["Hello, world  of tokens\n\nx", None, "", "a<|endoftext|>b", "é " * 2000]
    d = docs(spark, texts).select("doc_id", "text")
    rows = d.collect()
    back = spark.createDataFrame([(r.doc_id, r.text) for r in reversed(rows)] + [(2, "again")], d.schema)
    op4_token_codes.write_token_files(back, str(tmp_path / "codes"), shard_ids=8)
    got = op4_token_codes.read_documents(spark, str(tmp_path / "codes")).orderBy("start").collect()
    from vectrail.llm.tokens import encoder

    enc = encoder()
    start = 0
    assert [r.doc_id for r in got] == [0, 1, 2, 2, 3, 4]
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id != 2:
            ids = np.append(enc.whole([texts[r.doc_id] or ""])[0], 2).astype("<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    empty = spark.createDataFrame([], d.schema)
    op4_token_codes.write_token_files(empty, str(tmp_path / "none"))
    assert op4_token_codes.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_random_access():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 255, 256, 65535, 65536, 1 << 24, 4_000_000_000], 5000).astype(np.uint32)
    s = op4_token_codes.Shard(op4_token_codes.pack_shard([1, None], np.array([2000, 3000]), ids))
    assert (s.at(np.arange(5000)) == ids).all() and s.doc_ids == [1, None]
    assert all(s.token(i) == ids[i] for i in rng.integers(0, 5000, 500))
    assert (s.document(1) == ids[2000:]).all() and (s.document(0) == ids[:2000]).all()
    assert len(op4_token_codes.Shard(op4_token_codes.pack_shard([], np.zeros(0, np.int64), np.zeros(0, np.uint32))).at(np.zeros(0, np.int64))) == 0
