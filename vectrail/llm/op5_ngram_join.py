"""N-gram Jaccard join: documents whose sets of word n-grams are similar, and the groups that such links form.

Sets are ordered rarest first by how often each gram is held in the whole corpus, ties by hash. Two sets of similarity
t share a gram among the first n - ceil(t n) + 1 of each (prefix filter), so only prefix grams are joined. Pairs are
dropped whose sizes (length filter), places of the common gram (positional filter) or suffixes rule the overlap out: the
grams behind the common one are divided by fixed pivots, and the sizes of corresponding parts bound what they can
share (suffix filter); so do the parities of the whole sets. What is left is verified on the whole sets, once per pair.

Grams are counted exactly. Tasks send them in sorted, compressed runs, one for each range of hashes and each chunk of
sets; a gram that many sets of a chunk hold is sent once with its count. Where a range is counted, grams held once are
dropped and the others go back to their chunk with their counts. Grams held once come first in every order, so a set
whose prefix is full of them has no partner and leaves here. The postings of a common gram are dealt into tiles, so that no
task holds all of them; where all its pairs are wanted, tiles of its largest group meet tiles of the others, and these each
other.

Equal sets are one class from the start. For the groups, candidates are taken in rounds: first each class with the one
earlier class that shares most prefix grams with it, then each group's likeliest pair with another one until none of
them links, then all pairs that are still in different groups. A pair within a group cannot change the groups, so a cluster
of m near copies costs about m verifications, not m * m.

Grams are 64-bit hashes. A class is named by 64 bits, checked against 64 more that come from word hashes of another
seed; if two different sets had one name, all would be named anew. Chunks are named by task and order, so docs must be a
table that a repeated task reads in the same order (a Parquet scan is).
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import LOWER, M0, M1, documents, forget, map_batches, mix, null_safe_text, row_chunks, runs, small, text_buffers, word_hash, written
from vectrail.llm.components import components, regrouped

N, NUM, DEN = 4, 85, 100
#: Grams of a chunk of sets (a larger set is a chunk alone), and grams that a hash range has on average at most.
CHUNK_GRAMS, RANGE_GRAMS = 1 << 20, 1 << 19
PARITY_BITS = 512
#: A gram that so many sets of a chunk hold is sent once for them all; OFTEN marks its entry.
COMMON, OFTEN = 64, 65535
#: Classes that a task remembers, lest it send them again.
REMEMBERED = 200_000
#: Postings of a gram in a tile, about.
TILE = 256
#: Parts of a suffix, and the largest size that is told of one.
PARTS, PART_MOST = 8, 255
#: Other groups to which a posting proposes a pair in a round; all pairs follow after the rounds.
NEAREST = 4
#: Rows to drop, and pairs to verify, are broadcast up to this number (under 20 MB), else a shuffled join follows.
BROADCAST_IDS = 200_000
#: Tasks among which the rows of a group are spread where groups are joined by a shuffle.
SALTS = 8
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gram_sets(data: np.ndarray, cuts: np.ndarray, n: int = N, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram hash), sorted and distinct, of lower-cased texts laid end to end; a text with fewer than n words has one gram."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], cuts)
    h = word_hash(low, starts, ends, seed)
    first = np.searchsorted(starts, cuts)
    words = np.diff(first)
    acc = np.zeros(len(h), np.uint64)
    for k in range(min(n, len(h))):
        part = acc[: len(h) - k]
        acc[: len(h) - k] = mix(part * M1 + h[k:] + np.uint64(k + 1))
    row = np.repeat(np.arange(len(words)), words)
    ok = np.arange(len(h)) + n <= first[row + 1]
    short = np.nonzero((words > 0) & (words < n))[0]
    shorts = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = words[short] > k
        shorts[has] = mix(shorts[has] * M1 + h[first[short[has]] + k] + np.uint64(1000 * (k + 1)))
    rows, grams = np.concatenate([row[ok], short]), np.concatenate([acc[ok], shorts])
    order = np.argsort(grams)
    # A stable sort of 16-bit numbers is linear.
    order = order[np.argsort(rows[order].astype(np.uint16 if len(words) <= 1 << 16 else np.int64), kind="stable")]
    rows, grams = rows[order], grams[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[keep], grams[keep]


def batch_sets(b, column: int, n: int, *seeds: int):
    """Runs of rows of a batch: (first row, number of rows, (row, gram) for each seed)."""
    offsets, data = text_buffers(b.column(column))
    for lo, hi in row_chunks(offsets):
        yield lo, hi - lo, *(gram_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, seed) for seed in seeds or (0,))


def set_hash(rows: np.ndarray, grams: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(size, class hash) of each row's set."""
    size = np.bincount(rows, minlength=n)
    if not len(rows):
        return size, np.zeros(n, np.int64)
    starts = np.searchsorted(rows, np.arange(n))
    some = size > 0
    total = np.zeros(n, np.uint64)
    total[some] = np.add.reduceat(mix(grams ^ M1), starts[some])
    return size, mix(total + size.astype(np.uint64) + np.uint64(salt * int(M0) & (1 << 64) - 1)).view(np.int64)


def parities(rows: np.ndarray, grams: np.ndarray, n: int) -> list[bytes]:
    """For each row PARITY_BITS bits: whether an odd number of its grams falls to the bit. Two rows' differing bits are
    no more than the grams that only one of them has."""
    out = []
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        part = slice(*np.searchsorted(rows, (lo, hi)))
        bit = (grams[part] >> np.uint64(20)).astype(np.int64) % PARITY_BITS
        odd = np.bincount((rows[part] - lo) * PARITY_BITS + bit, minlength=(hi - lo) * PARITY_BITS) & 1
        out += [r.tobytes() for r in np.packbits(odd.astype(np.uint8).reshape(hi - lo, PARITY_BITS), axis=1)]
    return out


def least_overlap(a, b, num: int, den: int):
    """Smallest intersection of sets of sizes a and b with similarity num / den."""
    return -(-num * (a + b) // (num + den))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first sorted, as differences and byte planes, compressed."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, *types) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    data = np.frombuffer(pa.decompress(raw, n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=types[0])
    return out


def row_key() -> F.Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def describe(docs: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """(doc_id, key, sig, check, n_shingles) of every row."""

    def run(batches):
        for b in batches:
            for lo, k, (rows, grams), (rows2, grams2) in batch_sets(b, 2, n, 0, 1):
                size, sig = set_hash(rows, grams, k, salt)
                _, check = set_hash(rows2, grams2, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(sig), pa.array(check), pa.array(size.astype(np.int64))], ["doc_id", "key", "sig", "check", "n_shingles"])

    rows = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, key long, sig long, check long, n_shingles long")


def described_rows(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(rows as described, salt): no two different sets have the same sig."""
    rows = docs.count()
    for salt in itertools.count():
        described = written(describe(docs, n, salt), "described", rows)
        twins = described.groupBy("sig").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n_shingles").alias("c"), F.max("n_shingles").alias("d")).where("a <> b OR c <> d")
        if not twins.limit(1).count():
            return described, salt
        forget(described)


RUN = "range long, chunk long, n int, m int, data binary, sigs binary"


def run_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in RUN.split(", ")])


def gram_runs(docs: DataFrame, n: int, ranges_log2: int, salt: int = 0) -> DataFrame:
    """For each chunk of sets a run of (gram, set, weight) for each hash range, and a row with the chunk's classes and sizes.

    A gram that COMMON sets of the chunk hold is one entry of the set OFTEN, its weight their number; which sets they are
    stands in the chunk's own row. A task sends a class once.
    """

    def run(batches):
        task, chunks = TaskContext.get().partitionId(), 0
        seen: set[int] = set()
        held: list[tuple] = []
        grams_held = sets_held = 0

        def flush():
            chunk = task << 32 | chunks
            g, r = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(g)
            g, r = g[order], r[order].astype(np.uint16)
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            first = np.nonzero(new)[0]
            count = np.diff(np.append(first, len(g)))
            common = count >= COMMON
            of_common = np.repeat(common, count)
            hot_g, hot_r = g[of_common], r[of_common]
            keep = ~of_common
            keep[first[common]] = True
            w = np.ones(len(g), np.uint16)
            w[first[common]] = count[common]
            r[first[common]] = OFTEN
            g, r, w = g[keep], r[keep], w[keep]
            at = (g >> np.uint64(64 - ranges_log2)).astype(np.int64) if ranges_log2 else np.zeros(len(g), np.int64)
            edge = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(g)]]).tolist()
            rows = [(int(at[x]), chunk, y - x, 0, packed(g[x:y], r[x:y], w[x:y]), None) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            sigs, sizes = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            rows.append((chunk & ((1 << ranges_log2) - 1), chunk, len(sigs), len(hot_g), packed(hot_g, hot_r) if len(hot_g) else None, sigs.astype(np.int64).tobytes() + sizes.astype(np.int64).tobytes()))
            for i in range(0, len(rows), 4096):
                yield run_batch(rows[i : i + 4096])

        for b in batches:
            for _, k, (rows, grams) in batch_sets(b, 0, n):
                size, sig = set_hash(rows, grams, k, salt)
                fresh = np.zeros(k, bool)
                for i in np.nonzero(size)[0].tolist():
                    if (s := int(sig[i])) not in seen:
                        seen.add(s)
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                new = int(fresh.sum())
                if not new:
                    continue
                keep = fresh[rows]
                if held and (grams_held + int(keep.sum()) > CHUNK_GRAMS or sets_held + new >= OFTEN):
                    yield from flush()
                    held, grams_held, sets_held, chunks = [], 0, 0, chunks + 1
                number = np.cumsum(fresh) - 1 + sets_held
                held.append((grams[keep], number[rows[keep]], sig[fresh], size[fresh]))
                grams_held, sets_held = grams_held + int(keep.sum()), sets_held + new
        if held:
            yield from flush()

    return map_batches(null_safe_text(docs), run, RUN)


def of_key(batches, key: int):
    """Rows of batches sorted by a column, as lists of those with one value of it."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and row[key] != now:
                yield rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield rows


def counted(runs_: DataFrame) -> DataFrame:
    """The runs without the grams that are held once, each gram with its count; rows with classes as they are."""

    def run(batches):
        for rows in of_key(batches, 0):
            out = [r for r in rows if r[5] is not None]
            rows = [r for r in rows if r[5] is None]
            if rows:
                parts = [unpacked(r[4], r[2], np.uint64, np.uint16, np.uint16) for r in rows]
                g = np.concatenate([p[0] for p in parts])
                weight = np.concatenate([p[2] for p in parts]).astype(np.int64)
                order = np.argsort(g)
                s = g[order]
                first = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1])
                count = np.empty(len(g), np.int64)
                count[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(s))))
                at = 0
                for r, (grams, sets, _) in zip(rows, parts, strict=True):
                    c = count[at : at + len(grams)]
                    at += len(grams)
                    more = c > 1
                    if more.any():
                        out.append((r[0], r[1], int(more.sum()), 0, packed(grams[more], sets[more], np.minimum(c[more], 0xFFFFFFFF).astype(np.uint32)), None))
            for i in range(0, len(out), 1024):
                yield run_batch(out[i : i + 1024])

    return map_batches(runs_.repartition("range").sortWithinPartitions("range"), run, RUN)


def candidates(runs_: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, size, single, grams, tiles, parity) of the classes whose prefix holds a gram that is held twice.

    grams has those held twice at least, rarest first; single is the number of the others, which come before them. tiles
    has for each prefix gram the number of tiles that all its holders would fill.
    """

    def run(batches):
        for rows in of_key(batches, 1):
            ((k, m, hot, classes),) = [(r[2], r[3], r[4], np.frombuffer(r[5], np.int64)) for r in rows if r[5] is not None]
            parts = [unpacked(r[4], r[2], np.uint64, np.uint16, np.uint32) for r in rows if r[5] is None]
            if not parts:
                continue
            sigs, sizes = classes[:k], classes[k:]
            g, r, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            often = r == OFTEN
            if m:
                hot_g, hot_r = unpacked(hot, m, np.uint64, np.uint16)
                known, times = g[often], c[often]
                order = np.argsort(known)
                hot_c = times[order][np.searchsorted(known[order], hot_g)]
                g, r, c = (np.concatenate([a[~often], b]) for a, b in ((g, hot_g), (r, hot_r), (c, hot_c)))
            several = np.bincount(r, minlength=k)
            live = (several > 0) & (sizes - several < sizes - -(-num * sizes // den) + 1)
            keep = live[r]
            g, r, c = g[keep], r[keep], c[keep]
            order = np.lexsort((g, c, r))
            g, c, number = g[order], c[order], (np.cumsum(live) - 1)[r[order]]
            ends = np.cumsum(several[live])
            many = (sizes - -(-num * sizes // den) + 1 - (sizes - several))[live]
            tiles = (1 + c // TILE).astype(np.uint32)
            for lo in range(0, int(live.sum()), 1024):
                hi = min(lo + 1024, len(ends))
                x, y = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
                raw, raw_tiles = g[x:y].tobytes(), tiles[x:y].tobytes()
                cuts = [int(e) - x for e in ends[lo:hi]]
                spans = list(zip([0, *cuts[:-1]], cuts, strict=True))
                which = np.nonzero(live)[0][lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sigs[which]),
                        pa.array(sizes[which]),
                        pa.array(sizes[which] - several[which]),
                        pa.array([raw[8 * a : 8 * b] for a, b in spans], pa.binary()),
                        pa.array([raw_tiles[4 * a : 4 * min(b, a + p)] for (a, b), p in zip(spans, many[lo:hi].tolist(), strict=True)], pa.binary()),
                        pa.array(parities(number[x:y] - lo, g[x:y], hi - lo), pa.binary()),
                    ],
                    ["sig", "size", "single", "grams", "tiles", "parity"],
                )

    schema = "sig long, size long, single long, grams binary, tiles binary, parity binary"
    return map_batches(runs_.repartition("chunk").sortWithinPartitions("chunk"), run, schema).dropDuplicates(["sig"])


POSTING = "gram long, sig long, size int, pos int, tail long, m int, tile int"


def tails(rows: np.ndarray, grams: np.ndarray, n: int, firsts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each prefix gram, row by row, the sizes of the parts of what follows it: one byte a part."""
    part = (grams >> np.uint64(61)).astype(np.int64)
    total = np.bincount(rows * PARTS + part, minlength=n * PARTS).reshape(n, PARTS)
    index = np.arange(many.sum()) + np.repeat(firsts - (np.cumsum(many) - many), many)
    one = np.zeros((len(index), PARTS), np.int64)
    one[np.arange(len(index)), part[index]] = 1
    so_far = np.cumsum(one, axis=0)
    begin = np.cumsum(many) - many
    before = np.where(begin[:, None] > 0, so_far[begin - 1], 0)
    left = np.repeat(total, many, axis=0) - (so_far - np.repeat(before, many, axis=0))
    return np.minimum(left, PART_MOST).astype(np.uint8).view(np.int64).ravel()


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, sig, size, pos, tail, m, tile) of the prefix grams of every candidate class, but for those held once."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sig, size, single = (part.column(i).to_numpy() for i in range(3))
                sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column(3)]
                tiles = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in part.column(4)]).astype(np.int32)
                held = np.array([len(x) for x in sets_], np.int64)
                many = np.minimum(held, size - -(-num * size // den) + 1 - single)
                if not many.sum():
                    continue
                grams = np.concatenate(sets_)
                firsts = np.cumsum(held) - held
                tail = tails(np.repeat(np.arange(len(held)), held), grams, len(held), firsts, many)
                row = np.repeat(np.arange(len(many)), many)
                nth = np.arange(len(row)) - (np.cumsum(many) - many)[row]
                tile = (mix(sig[row].view(np.uint64)) % tiles.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[firsts[row] + nth].view(np.int64)), pa.array(sig[row]), pa.array(size[row].astype(np.int32)), pa.array((nth + single[row]).astype(np.int32)), pa.array(tail), pa.array(tiles), pa.array(tile)],
                    ["gram", "sig", "size", "pos", "tail", "m", "tile"],
                )

    return map_batches(sets.select("sig", "size", "single", "grams", "tiles"), run, POSTING)


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of the grams that two classes at least have: one pass over postings sorted by gram.

    A gram with several tiles is taken to be shared, since each of them is seen alone.
    """

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            g = t["gram"].to_numpy()
            other = np.nonzero(g != g[-1])[0]
            last = int(other[-1]) + 1 if len(other) else 0
            rest = t.slice(last)
            yield from keep(t.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from keep(rest)

    def keep(t):
        if not t.num_rows:
            return
        g, m = t["gram"].to_numpy(), t["m"].to_numpy()
        more = m > 1
        more[1:] |= g[1:] == g[:-1]
        more[:-1] |= g[1:] == g[:-1]
        yield from t.filter(pa.array(more)).combine_chunks().to_batches()

    return map_batches(postings.repartition("gram", "tile").sortWithinPartitions("gram", "tile"), run, POSTING)


def dealt_postings(shared: DataFrame, bits: DataFrame) -> DataFrame:
    """The postings with the single grams and parities of their classes, dealt into as many tiles as they fill."""
    counts = shared.where("m > 1").groupBy("gram", "m").agg(F.count("*").alias("n"))
    real = counts.select("gram", F.ceil(F.col("n") / TILE).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("tile"))
    rows = shared.join(real, ["gram", "tile"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.join(bits, "sig")
    return rows.select("gram", "sig", "size", "pos", "tail", "single", "parity", "parts", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("tile"))


def verify(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar: what two of them share is among the grams held twice.

    Few pairs are broadcast to the sets, so that only sets that a pair names are shuffled, however many rounds there are. For more
    all sets are.
    """
    side = lambda k: sets.select(F.col("sig").alias(k), F.col("size").alias(f"s{k}"), F.col("grams").alias(f"g{k}"))
    first, second = side("a"), side("b")
    if small(pairs, BROADCAST_IDS):
        pairs, second = F.broadcast(pairs), second.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb", "ga", "gb")

    def compare(batches):
        for b in batches:
            ok = []
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            for t, x, y in zip(total.tolist(), b.column(4), b.column(5), strict=True):
                common = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                ok.append(den * common >= num * (t - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(both, compare, "a long, b long")


def mixed_postings(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings, with their groups' root, whose grams have classes in several groups.

    A gram whose classes are all in one group has nothing to tell, nor later: groups only grow.
    """
    rows = shared.drop("root").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = rows.groupBy("gram", "parts").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = mixed.select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile"))
    return rows.join(mixed, ["gram", "tile"]).select("gram", "sig", "size", "pos", "tail", "single", "parity", "parts", "tile", "root")


#: Which postings of a task are compared: all, those of a gram's largest group with the others, or two tiles of the others.
ALL, MAJOR_MINOR, TWO_TILES = 0, 1, 2


def likely(g: list[np.ndarray], mode: int, i: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, need, shared at most) of the postings j behind i of a gram's task (sizes ascend) that the filters leave."""
    sig, size, pos, single, root, tile, tail, parity = g
    # Length filter: partners are a run after i.
    j = np.arange(i + 1, int(np.searchsorted(size, den * size[i] // num, "right")))
    if len(j):
        # In the modes that divide a gram, tile tells the two sides apart.
        j = j[(root[j] != root[i]) & ((mode == ALL) | (tile[j] != tile[i]))]
    need = least_overlap(size[i], size[j], num, den)
    if not len(j):
        return j, need, need
    # Positional and suffix filter: what stands before the gram (grams held once are never common), the gram, what follows.
    after, behind = size[i] - pos[i] - 1, size[j] - pos[j] - 1
    apart = np.maximum(np.abs(after - behind), np.abs(tail[j] - tail[i]).sum(axis=1))
    most = np.minimum(pos[i] - single[i], pos[j] - single[j]) + 1 + (after + behind - apart) // 2
    near = most >= need
    j, need, most = j[near], need[near], most[near]
    apart = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64) + single[j] + single[i]
    most = np.minimum(most, (size[i] + size[j] - apart) // 2)
    near = most >= need
    return j[near], need[near], most[near]


def cross_pairs(mixed: DataFrame, num: int, den: int, turn: int | None = None) -> DataFrame:
    """(a, b), a before b, of classes that share a prefix gram, pass the filters and are in different groups.

    With a turn, postings meet within tiles that change with it, each proposes only the likeliest pair with a larger set in
    each of the NEAREST likeliest other groups, and of these the likeliest of every two groups (ra, rb) stays, with its slack
    by the bound on what its sets share: no more rows than NEAREST times the postings. What this leaves out is found by a
    call without a turn. There each tile of a gram's largest group meets each tile of its other postings, and these tiles
    meet each other: a task has two tiles of a gram.
    """
    one = turn is not None
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["gram", "x", "y", "mode", "sig", "size", "pos", "single", "root", "side", "tail", "parity"]
    whole = {"y": F.lit(0), "mode": F.lit(ALL), "side": F.lit(0)}
    if one:
        # Half a tile, since nothing meets it.
        halves = F.pmod(F.xxhash64("sig", F.lit(turn)), 2 * F.col("parts")).cast("int")
        rows = mixed.withColumns({"x": F.when(F.col("parts") > 1, halves).otherwise(0), **whole}).select(*kept)
    else:
        several = mixed.where("parts > 1")
        sizes = several.groupBy("gram", "parts", "root").agg(F.count("*").alias("n")).groupBy("gram", "parts").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n"))
        sizes = sizes.select("gram", "major", F.ceil(F.col("most") / TILE).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("most")) / TILE).cast("int").alias("minors"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile"))
        several = several.join(sizes, ["gram", "tile"])
        place = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
        major = several.where("root = major").withColumns({"x": place("majors"), "mode": F.lit(MAJOR_MINOR), "side": F.lit(0)}).withColumn("y", every("minors"))
        minor = several.where("root <> major").withColumn("own", place("minors"))
        against = minor.withColumns({"y": F.col("own"), "mode": F.lit(MAJOR_MINOR), "side": F.lit(1)}).withColumn("x", every("majors"))
        among = minor.withColumn("other", every("minors")).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": F.col("own")})
        among = among.withColumn("mode", F.when(F.col("x") == F.col("y"), ALL).otherwise(TWO_TILES))
        rows = mixed.where("parts = 1").withColumns({"x": F.lit(0), **whole}).select(*kept)
        for part in (major, against, among):
            rows = rows.unionByName(part.select(*kept))
    dealt = rows.repartition("gram", "x", "y", "mode").sortWithinPartitions("gram", "x", "y", "mode", "size", "sig")

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(10)]  # gram to side
            cols.append(np.ascontiguousarray(b.column(10).to_numpy()).view(np.uint8).reshape(b.num_rows, PARTS).astype(np.int16))
            cols.append(np.frombuffer(b"".join(b.column(11).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = int(np.nonzero(changes(cols))[0][-1])
            rest = [c[last:] for c in cols]
            yield from emit([c[:last] for c in cols])
        if rest is not None:
            yield from emit(rest)

    def changes(cols):
        """Whether a row is the first of its gram, tiles and mode."""
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        return new

    def emit(cols):
        if not len(cols[0]):
            return
        edge = np.append(np.nonzero(changes(cols))[0], len(cols[0]))
        held, size = [], 0
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            root = cols[8][a:z]
            if z - a < 2 or (root == root[0]).all():
                continue
            for part in of_group([c[a:z] for c in cols[4:]], int(cols[3][a])):
                held.append(part)
                size += len(part[0])
                if size > 100_000:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def of_group(g, mode):
        sig, root = g[0], g[4]
        for i in range(len(sig) - 1):
            j, need, most = likely(g, mode, i, num, den)
            if not len(j):
                continue
            a, b = np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])
            if not one:
                yield a, b
                continue
            # How far the bound is above the need, in thousandths of it; of each group the first of the best.
            slack = (1000 * most // need).astype(np.int64)
            order = np.lexsort((sig[j], -slack))
            k = order[np.sort(np.unique(root[j[order]], return_index=True)[1])[:NEAREST]]
            yield a[k], b[k], np.minimum(root[i], root[j[k]]), np.maximum(root[i], root[j[k]]), slack[k]

    def out(held):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        if one:  # one pair of two groups from each part
            order = np.lexsort((cols[1], cols[0], -cols[4], cols[3], cols[2]))
            cols = [c[order] for c in cols]
            new = np.ones(len(order), bool)
            new[1:] = (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])
            return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in cols], ["a", "b", "ra", "rb", "slack"])
        p = np.unique(np.stack(cols, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    if one:
        found = map_batches(dealt, run, "a long, b long, ra long, rb long, slack long")
        return found.groupBy("ra", "rb").agg(F.max_by(F.struct("a", "b"), F.struct("slack", "a", "b")).alias("p"), F.max("slack").alias("slack")).select("ra", "rb", "p.a", "p.b", "slack")
    return map_batches(dealt, run, "a long, b long").distinct()


def one_each(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs of groups, the likeliest of each group; no more pairs than groups."""
    best = F.max_by(F.struct("a", "b"), F.struct("slack", "a", "b")).alias("p")
    ends = pairs.select(F.explode(F.array("ra", "rb")).alias("root"), "a", "b", "slack")
    return ends.groupBy("root").agg(best).select("p.a", "p.b").distinct()


def members(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> tuple[DataFrame, int]:
    """(doc_id, key, n_shingles, root) of every row of docs; root, null without words, names the row's group. And the rows' number."""
    described, salt = described_rows(docs, n)
    total, rows = described.agg(F.sum("n_shingles"), F.count("*")).first()
    total = total or 0
    ranges_log2 = min(24, (total // RANGE_GRAMS).bit_length())
    sets = written(candidates(counted(gram_runs(docs, n, ranges_log2, salt)), num, den), "sets", rows)
    shared = written(shared_postings(prefixes(sets, num, den)), "shared", rows)
    postings = written(dealt_postings(shared, sets.select("sig", "single", "parity")), "postings", rows)
    forget(shared)
    n_postings = postings.count()
    before = Window.partitionBy("gram", "tile").orderBy("size", "sig")
    near = postings.select(F.lag("sig").over(before).alias("a"), F.lag("size").over(before).alias("a_size"), F.col("sig").alias("b"), "size").where(F.col("a").isNotNull() & (den * F.col("a_size") >= num * F.col("size")))
    # A gram that few classes share says most about a pair, and in such a group neighbours are few.
    best = near.groupBy("b", "a").agg(F.count("*").alias("c")).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    tried = written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried", rows)
    roots = components(verify(sets, tried, num, den), rows)
    for turn in itertools.count():
        # Each group is tied to its likeliest neighbour, as often as that links, before all pairs are looked at.
        last, postings = postings, written(mixed_postings(postings, roots), "mixed", n_postings)
        forget(last)
        pairs = written(one_each(cross_pairs(postings, num, den, turn).join(tried, ["a", "b"], "left_anti")), "group-pairs", rows)
        more = written(verify(sets, pairs, num, den), "group-links", rows)
        last, tried = tried, written(tried.unionByName(pairs), "tried", rows)
        forget(last, pairs)
        if not more.limit(1).count():
            break
        roots = regrouped(roots, more, rows)
        forget(more)
    rest = written(cross_pairs(postings, num, den).join(tried, ["a", "b"], "left_anti"), "other-pairs")
    more = written(verify(sets, rest, num, den), "other-links")
    if more.limit(1).count():
        roots = regrouped(roots, more, rows)
    rooted = described.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    return rooted.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "sig")).alias("root")), rows


def groups(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; component_id is the smallest doc_id reachable by links.

    A row without words, or with a null text, has an empty set and its own id. Rows with a null doc_id belong to the
    component of their text but never name one; equal rows are linked to each other. Texts are whole, however long; an empty
    table gives no row, and columns other than doc_id and text are not read.
    """
    rows, total = members(docs, n, num, den)
    rows = written(rows, "members", total)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    named = with_group(rows, least.select("root", "component_id"), "left", total)
    # A group of one row has no entry, and a row without words no group: their own id.
    alone = F.col("component_id").isNull() & ~F.col("grouped")
    return named.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def with_group(rows: DataFrame, of_group: DataFrame, how: str, total: int) -> DataFrame:
    """rows with what of_group (root, ..) has of their group, and grouped, whether it has anything.

    Few groups are broadcast. More are shuffled, each several times, so that the rows of a large one are spread.
    """
    of_group = written(of_group.withColumn("grouped", F.lit(True)), "of-group", total)
    if small(of_group, BROADCAST_IDS):
        out = rows.join(F.broadcast(of_group), "root", how)
    else:
        spread = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], how).drop("salt")
    return out.withColumn("grouped", F.coalesce("grouped", F.lit(False)))


def keep_one(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each group: that of its smallest doc_id (a null id comes last, ties go to a hash of the text).

    Rows without words all stay. Of rows that repeat the id and the text of the one that stays, one stays, any of them.
    Columns may have any names; an empty table stays empty.
    """
    rows, total = members(docs, n, num, den)
    rows = written(rows.where("root IS NOT NULL"), "members", total)
    name = uuid.uuid4().hex
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    named = with_group(rows, best.select("root", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key")), "inner", total)
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key"))
    gone = written(named.where(~stays).select(F.col("doc_id").alias(f"id_{name}"), F.col("key").alias(f"key_{name}")).distinct(), "gone", total)
    twice = named.where(stays).groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias(f"id_{name}"), F.col("key").alias(f"key_{name}"))
    twice = written(twice, "twice", total)
    same = lambda: docs["doc_id"].eqNullSafe(F.col(f"id_{name}")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f"key_{name}"))
    side = lambda df: F.broadcast(df) if small(df, BROADCAST_IDS) else df
    left = docs.join(side(gone), same(), "left_anti")
    if not twice.limit(1).count():
        return left
    again = left.join(side(twice), same(), "left_semi").withColumn(f"key_{name}", row_key()).dropDuplicates(["doc_id", f"key_{name}"]).drop(f"key_{name}")
    return left.join(side(twice), same(), "left_anti").unionByName(again)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
