"""What the operators share: text buffers, word hashes, lean Python stages and folders that all executors see."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer text is worked on alone.
CHUNK = 1 << 18
#: Bytes of an Arrow batch between the JVM and a Python worker, where the session has Spark's default of 64 MB.
BATCH_BYTES = "4m"
#: Rows of a file, at least, where the number of rows is known.
FILE_ROWS = 20_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
# Multipliers of the hashes: odd, otherwise arbitrary.
M0 = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder of this machine serves if the master is local; on a cluster this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/vectrail-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when an executor is lost.

    Where rows, a bound on its number of rows, is given, it is written by no more tasks than these need.
    """
    path = shared_folder(df.sparkSession, name)
    df = df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has no more rows; reads no further than it must."""
    return df.limit(rows + 1).count() <= rows


def release() -> None:
    """Gives the memory that a worker no longer uses back to the machine; idle workers keep only what they cache."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes and workers that give memory back at a task's end."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64m", "64MB"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int32).astype(np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def row_chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first row, end row) of runs of rows that hold about size bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h ^= h >> np.uint64(33)
    h *= M2
    return h ^ (h >> np.uint64(33))


def eights(data: np.ndarray) -> np.ndarray:
    """A view: the eight bytes from each place of the data; behind its end they are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, 8)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, which depends on these bytes and the seed alone.

    Eight bytes at a time are scrambled into it, so no two words of one length of up to eight bytes share a hash; longer
    words do with the chance of 2**-64 a pair, whatever their structure. Words beyond LONG_WORD take a BLAKE2 digest.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + np.uint64((seed + 1) * int(M0) & (1 << 64) - 1))
    window = eights(data)
    rest = np.nonzero((size > 0) & (size <= LONG_WORD))[0]
    at = 0
    while len(rest):
        left = size[rest] - at
        x = window[starts[rest] + at].view(np.uint64).ravel()
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        h[rest] = mix(h[rest] * M0 + x)
        rest, at = rest[left > 8], at + 8
    for i in np.nonzero(size > LONG_WORD)[0].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses one of the cuts (sorted positions)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(mask) + 1, bool)
    edge[0], edge[-1] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    e = np.nonzero(edge)[0]
    starts, ends = e[::2], e[1::2]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    inner = inner[mask[inner] & mask[inner - 1]] if len(inner) else inner
    if len(inner):
        inner = np.unique(inner)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def null_safe_text(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.coalesce("text", F.lit("")).alias("text"))


def hash_texts(texts: list[str]) -> np.ndarray:
    """Signed 64-bit hash of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(size)
    return word_hash(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends).view(np.int64)
