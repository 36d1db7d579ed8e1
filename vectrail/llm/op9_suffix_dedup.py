"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes around it also starts earlier (in a smaller doc_id, or earlier in the same
document). Suffixes are bucketed by their first eight bytes, and buckets are refined by sorting on the buckets of later
offsets: buckets of depth d at p and at p + d give those of depth 2 d, and so on until they agree on LENGTH bytes. Each
refinement uses the pointers of the one before; a suffix alone in its bucket is settled.

Only suffixes that can be repeated are sorted, in tasks that need not know each other: in every string of LENGTH bytes the
Q-gram with the smallest hash is an anchor, so equal strings have equal anchors at equal places, and anchors are dealt out
by their Q-gram. Of texts that are wholly equal (SHA-256) only the first one is looked at, and of anchors whose
surroundings, as far as a string around them can reach, have the same BLAKE2 digest of 128 bits only the first one is
refined: the others repeat it wholly. A task sends surroundings that it remembers no second time, so a passage that a third of
all documents holds costs a few rows a task. The surroundings of a Q-gram that has many different ones are dealt once more:
strings are divided by how far before the Q-gram they start, STEP places a class, and the surroundings go to each class
by the bytes that all its strings have in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import CHUNK, M0, M1, M2, documents, eights, map_batches, mix, row_chunks, small, text_buffers, written

LENGTH, Q, START = 100, 24, 8
REACH = LENGTH - Q
STEP = 11
#: Rows that travel by broadcast (16 to 40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SPANS = 250_000
#: Surroundings that are refined at once, and those of a Q-gram beyond which they are dealt once more.
CONTEXTS, BIG = 4_000, 2_000
#: Surroundings that a task remembers, as a power of two.
REMEMBERED_LOG2 = 17


def anchors(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are smallest in some window of LENGTH bytes of a text; ties go to the left.

    data has texts laid end to end, cuts their ends after a 0. Windows are looked at in bounded runs.
    """
    ends = np.repeat(cuts[1:], np.diff(cuts))
    places, hashes = [], []
    width = REACH + 1
    for lo in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        n = min(CHUNK, len(data) - LENGTH + 1 - lo)
        y = mix(np.ascontiguousarray(eights(data[lo : lo + n + LENGTH - 1])[: n + LENGTH - START]).view(np.uint64).ravel())
        h = mix(y[: -2 * START] * M0 + y[START:-START] * M1 + y[2 * START :] * M2)
        m = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])[:n]
        at = (m[np.arange(lo + LENGTH, lo + n + LENGTH) <= ends[lo : lo + n]] & np.uint64(0xFFFFFF)).astype(np.int64)
        if len(at):
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            places.append(at + lo)
            hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return at[new], h[new]


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): did orders documents, a null doc_id first; th tells rows apart that share a doc_id.

    Rows with the same doc_id and text are one document; of rows that share a doc_id only, that with the smaller hash of
    its text counts as the earlier one.
    """
    rows = with_keys(docs, twice := has_twins(docs)).select("did", "th", "text")
    return rows.dropDuplicates(["did", "text"]) if twice else rows


def has_twins(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def with_keys(docs: DataFrame, twins: bool) -> DataFrame:
    th = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long") if twins else F.lit(0).cast("long")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("did"), th.alias("th"), F.coalesce("text", F.lit("")).alias("text"))


KEYS = "did long, th long"


def later_copies(rows: DataFrame) -> DataFrame:
    """(did, th, n) of the documents whose whole text is that of an earlier one, with its bytes."""
    names = rows.select("did", "th", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    names = written(names.where(F.col("n") >= LENGTH), "texts")
    first = names.groupBy("sha").agg(F.min(F.struct("did", "th")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return written(names.join(first, "sha").where("did <> first.did OR th <> first.th").select("did", "th", "n"), "copies")


class Remembered:
    """Digests of surroundings and the least place where this task has seen them; a slot holds the last that came to it."""

    def __init__(self):
        n = 1 << REMEMBERED_LOG2
        self.a, self.b, self.did, self.th, self.at = (np.zeros(n, np.int64) for _ in range(5))
        self.used = np.zeros(n, bool)

    def repeats(self, a, b, did, th, at) -> np.ndarray:
        """Which of these repeat a place seen before; the others are remembered."""
        order = np.lexsort((at, th, did, b, a))
        again = np.zeros(len(a), bool)
        x, y = order[1:], order[:-1]
        again[x] = (a[x] == a[y]) & (b[x] == b[y])
        slot = a & ((1 << REMEMBERED_LOG2) - 1)
        held = self.used[slot] & (self.a[slot] == a) & (self.b[slot] == b)
        sooner = (self.did[slot] < did) | ((self.did[slot] == did) & ((self.th[slot] < th) | ((self.th[slot] == th) & (self.at[slot] < at))))
        again |= held & sooner
        new = np.nonzero(~again)[0]
        _, last = np.unique(slot[new], return_index=True)
        new = new[last]
        for mine, values in ((self.a, a), (self.b, b), (self.did, did), (self.th, th), (self.at, at)):
            mine[slot[new]] = values[new]
        self.used[slot[new]] = True
        return again


def find_anchors(rows: DataFrame) -> DataFrame:
    """(gram, a, b, did, th, at, before, behind) of every anchor: a and b are the digest of what lies within REACH, before and
    behind how far that is. A null gram marks surroundings that the same task has seen at an earlier place."""

    def run(batches):
        memory = Remembered()
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in row_chunks(offsets):
                cuts = offsets[lo : hi + 1] - offsets[lo]
                text = data[offsets[lo] : offsets[hi]]
                at, gram = anchors(text, cuts)
                if not len(at):
                    continue
                row = np.searchsorted(cuts, at, "right") - 1
                before, behind = np.minimum(at - cuts[row], REACH), np.minimum(cuts[row + 1] - at, LENGTH)
                raw = text.tobytes()
                digests = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip((at - before).tolist(), (at + behind).tolist(), strict=True)]
                a, b = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
                a = a + before
                inner, of, th_ = at - cuts[row], did[lo + row], th[lo + row]
                again = memory.repeats(a, b, of, th_, inner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64), mask=again), pa.array(a), pa.array(b), pa.array(of), pa.array(th_), pa.array(inner), pa.array(before.astype(np.int16)), pa.array(behind.astype(np.int16))],
                    ["gram", "a", "b", "did", "th", "at", "before", "behind"],
                )

    return map_batches(rows, run, f"gram long, a long, b long, {KEYS}, at long, before short, behind short")


PLACE = f"gram long, {KEYS}, at long, start long, end long"


def sort_anchors(found: DataFrame) -> DataFrame:
    """(gram, did, th, at, start, end): with a null gram, a part of a text that repeats an earlier one; else an anchor to refine.

    One pass over anchors sorted by gram, surroundings and place; only the last anchor is held.
    """

    def run(batches):
        last = None  # (gram, digest, first row of these surroundings, whether that row has been sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if told.any():
                yield places(*(c[told] for c in columns(batch)), None)
                if told.all():
                    continue
                batch = batch.filter(pa.array(~told))
            g, a, b, did, th, at, before, behind = columns(batch)
            n = len(g)
            new_g, new = np.ones(n, bool), np.ones(n, bool)
            new_g[1:] = g[1:] != g[:-1]
            new[1:] = new_g[1:] | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if last is not None:
                new_g[0] = g[0] != last[0]
                new[0] = new_g[0] or (a[0], b[0]) != last[1]
            firsts = np.nonzero(new)[0]
            # A first is refined if its gram has other surroundings before or behind it.
            more = ~new_g[firsts]
            more[:-1] |= ~new_g[firsts[1:]]
            if last is not None and len(firsts) and not new_g[firsts[0]] and not last[3]:
                yield places(*(np.array([x]) for x in last[2]), True)
            cols = (g, a, b, did, th, at, before, behind)
            if more.any():
                yield places(*(c[firsts[more]] for c in cols), True)
            if not new.all():
                yield places(*(c[~new] for c in cols), None)
            if len(firsts):
                f = firsts[-1]
                last = (int(g[-1]), (a[-1], b[-1]), tuple(c[f] for c in cols), bool(more[-1]))

    def columns(batch):
        return [batch.column(i).to_numpy(zero_copy_only=False) if not i else batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]

    def places(g, a, b, did, th, at, before, behind, refined):
        gram = pa.array(g.astype(np.int64)) if refined else pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([gram, *map(pa.array, (did, th, at, at - before, at + behind))], ["gram", "did", "th", "at", "start", "end"])

    dealt = found.repartition(F.coalesce("gram", F.xxhash64("did", "at"))).sortWithinPartitions("gram", "a", "b", "did", "th", "at")
    return map_batches(dealt, run, PLACE)


def refine(pointers: np.ndarray, depth: int, step: int, room: np.ndarray) -> np.ndarray:
    """Pointers of depth + step from those of depth: shared buckets are divided by the pointers step places on.

    A suffix alone in its bucket keeps a bucket of its own; one without room for the new depth has none.
    """
    out = np.full(len(pointers), -1, np.int64)
    place = np.nonzero(room >= depth + step)[0]
    shared = np.bincount(pointers[pointers >= 0])[pointers[place]] > 1
    out[place[~shared]] = place[~shared]
    place = place[shared]
    if len(place):
        key = pointers[place] * (pointers.max() + 1) + pointers[place + step]
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        out[place[order]] = len(pointers) + np.cumsum(new) - 1
    return out


def string_buckets(data: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place a pointer, equal where the next length bytes are; -1 without so much room."""
    place = np.nonzero(room >= START)[0]
    pointers = np.full(len(data), -1, np.int64)
    if len(place):
        pointers[place] = np.unique(eights(data)[place].view(np.uint64).ravel(), return_inverse=True)[1]
    depth = START
    while depth < length:
        step = min(depth, length - depth)
        pointers = refine(pointers, depth, step, room)
        depth += step
    return pointers


def repeated(texts: list[bytes], did: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the strings of LENGTH bytes in the contexts that also start earlier in one of them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    context = np.repeat(np.arange(len(texts)), sizes)
    inner = np.arange(len(data)) - base[context]
    pointers = string_buckets(data, sizes[context] - inner)
    whole = np.nonzero(pointers >= 0)[0]
    whole = whole[np.bincount(pointers[whole])[pointers[whole]] > 1] if len(whole) else whole
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, con = pointers[whole], context[whole]
    place = start[con] + inner[whole]
    order = np.lexsort((place, th[con], did[con], cls))
    cls, con, place, pos = cls[order], con[order], place[order], inner[whole][order]
    first = np.searchsorted(cls, cls)
    later = (place != place[first]) | (did[con] != did[con[first]]) | (th[con] != th[con[first]])
    return con[later], pos[later]


def refine_buckets(contexts: DataFrame) -> DataFrame:
    """(did, th, start, end) of repeats among the contexts (gram, side, part, did, th, start, text) of each bucket."""

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < CONTEXTS:
                continue
            new = np.zeros(rest.num_rows, bool)
            for name in ("gram", "side", "part"):
                c = rest[name].to_numpy()
                new[1:] |= c[1:] != c[:-1]
            other = np.nonzero(new)[0]
            if len(other):
                cut = int(other[-1])
                yield from emit(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    def emit(t):
        did, th, start = (t[c].to_numpy() for c in ("did", "th", "start"))
        con, pos = repeated(t["text"].to_pylist(), did, th, start)
        if not len(con):
            return
        order = np.lexsort((pos, con))
        con, pos = con[order], pos[order]
        new = np.ones(len(con), bool)
        new[1:] = (con[1:] != con[:-1]) | (pos[1:] > pos[:-1] + LENGTH)
        at = np.nonzero(new)[0]
        end = np.append(at[1:], len(con)) - 1
        c = con[at]
        yield pa.RecordBatch.from_arrays([pa.array(did[c]), pa.array(th[c]), pa.array(start[c] + pos[at]), pa.array(start[c] + pos[end] + LENGTH)], ["did", "th", "start", "end"])

    dealt = contexts.repartition("gram", "side", "part").sortWithinPartitions("gram", "side", "part")
    return map_batches(dealt, run, f"{KEYS}, start long, end long")


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, side, part, did, th, start, text): the bytes of the wanted parts, read from their documents.

    Surroundings of a Q-gram with BIG different ones go out once for each class of strings, as far as these reach; the bytes that
    all strings of the class hold, some 90, name the part.
    """

    def sides(raw, p):
        at, start, end = p["at"], p["start"], p["end"]
        if not p["big"]:
            yield 0, 0, start, end
            return
        for side, least in enumerate(range(0, REACH + 1, STEP)):
            most = min(least + STEP - 1, REACH)
            # Strings start least to most places before the anchor; some must lie in the surroundings.
            if max(least, at + LENGTH - end) <= min(most, at - start):
                core = raw[at - least : at - most + LENGTH]
                name = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                yield side + 1, name, max(start, at - most), min(end, at - least + LENGTH)

    def run(batches):
        for b in batches:
            offsets, data = text_buffers(b.column(2))
            did, th = b.column(0).to_pylist(), b.column(1).to_pylist()
            for r, parts in enumerate(b.column(3).to_pylist()):
                text = data[offsets[r] : offsets[r + 1]]
                raw = text.tobytes()
                out = [(p["gram"], *side) for p in parts for side in sides(raw, p)]
                if out:
                    gram, side, part, start, end = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram, pa.int64()), pa.array(side, pa.int32()), pa.array(part, pa.int64()), pa.array([did[r]] * len(out), pa.int64()), pa.array([th[r]] * len(out), pa.int64()), pa.array(start, pa.int64()), pa.array([raw[x:y] for x, y in zip(start, end, strict=True)], pa.binary())],
                        ["gram", "side", "part", "did", "th", "start", "text"],
                    )

    big = written(wanted.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > BIG).select("gram", F.lit(True).alias("big")), "big-buckets")
    marked = wanted.join(F.broadcast(big) if small(big, BROADCAST_SPANS) else big, "gram", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    lists = marked.groupBy("did", "th").agg(F.collect_list(F.struct("gram", "at", "start", "end", "big")).alias("parts"))
    both = rows.join(lists, ["did", "th"]).select("did", "th", "text", "parts")
    return map_batches(both, run, f"gram long, side int, part long, {KEYS}, start long, text binary")


def merged_spans(parts: DataFrame) -> DataFrame:
    """(did, th, spans): the union of each document's parts as ascending runs."""

    def run(batches):
        for b in batches:
            out = []
            for parts in b.column(2):
                v = parts.values.flatten()
                s, e = (x.to_numpy(zero_copy_only=False) for x in v)
                o = np.argsort(s, kind="stable")
                s, e = s[o], np.maximum.accumulate(e[o])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                at = np.nonzero(new)[0]
                out.append(np.stack([s[at], e[np.append(at[1:], len(s)) - 1]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["did", "th", "spans"])

    return map_batches(parts.groupBy("did", "th").agg(F.collect_list(F.struct("start", "end")).alias("parts")), run, f"{KEYS}, spans array<long>")


def repeats(docs: DataFrame) -> DataFrame:
    """(did, th, spans) of the documents with bytes to remove; spans lists starts and ends in turn."""
    rows = keyed(docs)
    copies = later_copies(rows)
    rows = rows.join(F.broadcast(copies) if small(copies, BROADCAST_SPANS) else copies, ["did", "th"], "left_anti")
    places = written(sort_anchors(find_anchors(rows)), "anchors")
    more = refine_buckets(fetch(rows, places.where("gram IS NOT NULL")))
    whole = places.where("gram IS NULL").select("did", "th", "start", "end")
    spans = merged_spans(whole.unionByName(more)).unionByName(copies.select("did", "th", F.array(F.lit(0).cast("long"), "n").alias("spans")))
    return written(spans, "spans")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs; a null text is empty. kept holds the other bytes.

    A null doc_id comes first. Rows that repeat doc_id and text are one document and have one result. Texts are whole,
    however long; an empty table gives no row, and columns other than doc_id and text are not read.
    """
    spans = repeats(docs)
    few = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= 2 * BROADCAST_SPANS
    rows = with_keys(docs, has_twins(docs))
    both = rows.join(F.broadcast(spans) if few else spans, ["did", "th"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            offsets, data = text_buffers(b.column(1))
            size, gone, count, kept = [], [], [], []
            for r, spans in enumerate(b.column(2).to_pylist()):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                s = spans or []
                edges = [0, *s, len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                count.append(len(s) // 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
