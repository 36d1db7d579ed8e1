"""Token-id output in directly addressable codes.

Every id is split into 8-bit chunks, lowest first. Level j holds the j-th chunk of each id that has one, a bitmap says
which of them continue at level j + 1, and a rank directory (one count for each 512 bits) turns a position at one
level into that at the next. So any token is read by as many probes as it has chunks, without decoding its block.

A shard holds whole documents in ascending doc_id order and is one uncompressed file, named by its task, its number in
the task and its number of ids: part=P/seq=S/n_ids=N/. All numbers are little-endian:

    b"DAC2", depth u32, documents u64, ids u64
    for each level: places of its chunks, its bitmap and its directory, u64
    for each document: doc_id i64 (a null is the least one); then the number of ids up to its end, u64; then 1 for a null, u8
    for each level: chunks u8; bitmap, padded to whole blocks; directory u32

The list of files gives the first position of every shard, and the header that of every part of it, so TokenFiles reads a
token with a few short reads, wherever it stands.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import map_batches, null_safe_text, shared_folder, table
from vectrail.llm.tokens import encode_column

MAGIC = b"DAC2"
BLOCK = 512
END_ID = 2
#: A shard is closed once it holds this many ids (it may hold more: documents are never divided); some 9 MB.
SHARD_IDS = 1 << 22
HEADER, LEVEL = struct.Struct("<4sIQQ"), struct.Struct("<QQQ")
NULL_ID = -(2**63)


def encode_codes(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes in whole blocks, rank directory) of each level."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        bits = np.zeros(-(-len(rest) // BLOCK) * (BLOCK // 8), np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        levels.append(((rest & 255).astype(np.uint8), bits, (np.cumsum(counts) - counts).astype(np.uint32)))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def pack_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode_codes(ids)
    n = len(doc_ids)
    at = HEADER.size + LEVEL.size * len(levels) + 17 * n
    places, body = [], []
    for level in levels:
        where = []
        for part in level:
            body.append(b"\0" * (-at % 8))
            at += -at % 8
            where.append(at)
            body.append(part.tobytes())
            at += part.nbytes
        places.append(LEVEL.pack(*where))
    documents = [np.array([NULL_ID if x is None else x for x in doc_ids], np.int64).tobytes(), np.cumsum(lengths).astype(np.uint64).tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes()]
    return b"".join([HEADER.pack(MAGIC, len(levels), n, len(ids)), *places, *documents, *body])


class Shard:
    """A whole shard in memory: ids at any positions, level by level for all of them at once."""

    def __init__(self, raw: bytes):
        magic, depth, n, self.n_ids = HEADER.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of token codes")
        places = [LEVEL.unpack_from(raw, HEADER.size + LEVEL.size * j) for j in range(depth)]
        at = HEADER.size + LEVEL.size * depth
        ids = np.frombuffer(raw, np.int64, n, at).tolist()
        self.ends = np.frombuffer(raw, np.uint64, n, at + 8 * n).astype(np.int64)
        self.doc_ids = [None if m else x for m, x in zip(np.frombuffer(raw, np.uint8, n, at + 16 * n).tolist(), ids, strict=True)]
        self.lengths = np.diff(self.ends, prepend=0)
        self.levels, size = [], self.n_ids
        for chunks, bits, ranks in places:
            blocks = -(-size // BLOCK)
            words = np.frombuffer(raw, np.uint64, blocks * (BLOCK // 64), bits)
            before = np.bitwise_count(words).reshape(-1, BLOCK // 64).astype(np.int64)
            before = (np.cumsum(before, axis=1) - before).ravel()  # set bits of the words before, in their block
            self.levels.append((np.frombuffer(raw, np.uint8, size, chunks), words, before, np.frombuffer(raw, np.uint32, blocks, ranks)))
            size = int(np.bitwise_count(words).sum())

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions: a probe of each level for those that reach it."""
        i = np.asarray(positions, np.int64)
        out = np.zeros(len(i), np.uint32)
        live = np.arange(len(i))
        for j, (chunks, words, before, ranks) in enumerate(self.levels):
            out[live] |= chunks[i].astype(np.uint32) << np.uint32(8 * j)
            word, bit = words[i >> 6], (i & 63).astype(np.uint64)
            more = (word >> bit & np.uint64(1)).astype(bool)
            if not more.any():
                break
            i, word, bit, live = i[more], word[more], bit[more], live[more]
            i = ranks[i // BLOCK] + before[i >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return out

    def token(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def document(self, k: int) -> np.ndarray:
        return self.at(np.arange(self.ends[k] - self.lengths[k], self.ends[k]))


FILE = re.compile(r"/part=(\d+)/seq=(\d+)/n_ids=(\d+)/[^/]+$")


class TokenFiles:
    """Random access to the files under a path, in any store that Spark reads, without reading or decoding a block.

    bytes_read counts what was read. Only the list of files is held.
    """

    def __init__(self, spark, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        root = self.hadoop.Path(path)
        self.store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found, walk = [], self.store.listFiles(root, True)
        while walk.hasNext():
            name = walk.next().getPath().toString()
            if m := FILE.search(name):
                found.append((int(m[1]), int(m[2]), int(m[3]), name))
        found.sort()
        self.names = [f[3] for f in found]
        self.starts = [0]
        for f in found:
            self.starts.append(self.starts[-1] + f[2])
        self.bytes_read = 0
        self._open: tuple[int, object] = (-1, None)
        self._headers: dict[int, tuple] = {}

    def __len__(self) -> int:
        return self.starts[-1]

    def _read(self, shard: int, at: int, n: int) -> bytes:
        if self._open[0] != shard:
            self.close()
            self._open = (shard, self.store.open(self.hadoop.Path(self.names[shard])))
        stream = self._open[1]
        stream.seek(at)
        self.bytes_read += n
        return bytes(stream.readNBytes(n))

    def close(self) -> None:
        if self._open[1] is not None:
            self._open[1].close()
        self._open = (-1, None)

    def _header(self, shard: int):
        """(number of documents, places of the levels, place of the documents)"""
        if shard not in self._headers:
            magic, depth, n, _ = HEADER.unpack(self._read(shard, 0, HEADER.size))
            if magic != MAGIC:
                raise ValueError("not a shard of token codes")
            raw = self._read(shard, HEADER.size, LEVEL.size * depth)
            self._headers[shard] = n, list(LEVEL.iter_unpack(raw)), HEADER.size + LEVEL.size * depth
        return self._headers[shard]

    def _token(self, shard: int, i: int) -> int:
        value = 0
        for j, (chunks, bits, ranks) in enumerate(self._header(shard)[1]):
            value |= self._read(shard, chunks + i, 1)[0] << 8 * j
            block = int.from_bytes(self._read(shard, bits + i // BLOCK * (BLOCK // 8), BLOCK // 8), "little")
            if not block >> i % BLOCK & 1:
                break
            rank = int.from_bytes(self._read(shard, ranks + 4 * (i // BLOCK), 4), "little")
            i = rank + (block & ((1 << i % BLOCK) - 1)).bit_count()
        return value

    def token(self, position: int) -> int:
        """The id at a position of all ids, from 0."""
        if not 0 <= position < len(self):
            raise IndexError(position)
        shard = bisect_right(self.starts, position) - 1
        return self._token(shard, position - self.starts[shard])

    def _doc_id(self, shard: int, k: int) -> int:
        return int.from_bytes(self._read(shard, self._header(shard)[2] + 8 * k, 8), "little", signed=True)

    def place(self, doc_id: int | None) -> tuple[int, int, int]:
        """(shard, first id in it, number of ids) of a document (of rows that share the id, the first), by binary search."""
        key = NULL_ID if doc_id is None else doc_id
        lo, hi = 0, len(self.names)
        while lo < hi:  # the first shard whose last document is not before the key
            mid = (lo + hi) // 2
            if self._doc_id(mid, self._header(mid)[0] - 1) < key:
                lo = mid + 1
            else:
                hi = mid
        if lo == len(self.names):
            raise KeyError(doc_id)
        shard, (n, _, at) = lo, self._header(lo)
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            if self._doc_id(shard, mid) < key:
                lo = mid + 1
            else:
                hi = mid
        if self._doc_id(shard, lo) != key:
            raise KeyError(doc_id)
        ends = self._read(shard, at + 8 * n + 8 * max(lo - 1, 0), 16 if lo else 8)
        first, end = (int.from_bytes(ends[:8], "little"), int.from_bytes(ends[8:], "little")) if lo else (0, int.from_bytes(ends, "little"))
        return shard, first, end - first

    def lookup(self, doc_id: int | None, i: int) -> int:
        """The i-th id of a document, its end id included."""
        shard, first, n = self.place(doc_id)
        if not 0 <= i < n:
            raise IndexError(i)
        return self._token(shard, first + i)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes docs (doc_id, text; other columns are not read, whatever their names) in ascending doc_id order into shards.

    A null text is empty; a null doc_id comes first; repeated rows are kept, one after the other. Texts are whole, however
    long. An empty table gives no shard.
    """

    def run(batches):
        doc_ids, lengths, pieces, n, seq = [], [], [], 0, 0

        def flush():
            ids = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
            row = pack_shard(doc_ids, np.array(lengths, np.int64), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([row], pa.binary())], ["part", "seq", "n_ids", "shard"])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            keys = b.column(0).to_pylist()
            for lo, ids, bounds in encode_column(b.column(1), tokenizer):
                k = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id)
                doc_ids += keys[lo : lo + k]
                lengths += (np.diff(bounds) + 1).tolist()
                pieces.append(ids.astype(np.uint32))
                n += len(ids)
                if n >= shard_ids:
                    yield flush()
                    doc_ids, lengths, pieces, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()
    dealt = null_safe_text(docs, "doc_id").repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    shards = map_batches(dealt, run, "part int, seq long, n_ids long, shard binary")
    # Spark's text writer puts out the bytes of a string as they are, and a line end, which nothing reads.
    shards.select("part", "seq", "n_ids", F.col("shard").cast("string").alias("value")).write.partitionBy("part", "seq", "n_ids").option("compression", "none").text(path)


def read_shards(spark, path: str) -> DataFrame:
    """(part, seq, n_ids, content) of every file under path."""
    files = spark.read.format("binaryFile").load(path)
    if "part" not in files.columns:  # no file was written
        return spark.createDataFrame([], "part int, seq long, n_ids long, content binary")
    return files.select(F.col("part").cast("int"), F.col("seq").cast("long"), F.col("n_ids").cast("long"), "content")


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under path, its ids selected from the codes."""
    shards = read_shards(spark, path)

    def run(batches):
        for b in batches:
            for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Shard(raw.as_py())
                starts = s.ends - s.lengths
                for lo in range(0, len(starts), 256):
                    hi = min(lo + 256, len(starts))
                    base = int(starts[lo])
                    view = memoryview(s.at(np.arange(base, s.ends[hi - 1])).astype("<u4").tobytes())
                    crc = [zlib.crc32(view[4 * (a - base) : 4 * (e - base)]) for a, e in zip(starts[lo:hi].tolist(), s.ends[lo:hi].tolist(), strict=True)]
                    k = hi - lo
                    yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int64()), pa.array(s.doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi]), pa.array(s.lengths[lo:hi]), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = map_batches(shards.select("part", "seq", "content"), run, "part int, seq long, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Ids before a shard: those of earlier parts (a row for each part), and of earlier shards of its part.
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    places = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("shard_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("first"))
    return rows.join(places, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_codes(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-codes")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
