"""Helpers shared by the text operators: Arrow string columns seen as numpy byte and code-point arrays.

All functions work on one Arrow batch inside a Spark task. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once (one longer text is taken alone).
CHUNK_BYTES = 2 << 20

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, _U64)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def fresh(df, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names (set here only where it is unset)."""
    import uuid

    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """Only a local session may go without spark.checkpoint.dir; on a cluster tasks elsewhere see no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df, name: str):
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession, name)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with at most `limit` bytes of text, or one row."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    col = col.fill_null("")
    if not len(col):
        return
    off = offsets(col)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, col.slice(a, b - a)
        a = b


def offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins (one more for the end)."""
    off = offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), 0x9E3779B97F4A7C15, _U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def spans_hash(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, which do not overlap and go upwards."""
    sizes = ends - begins
    if not len(begins):
        return np.zeros(0, _U64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    terms = (buf[np.repeat(begins, sizes) + place].astype(_U64) + _U64(1)) * _powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(terms, at[:-1]) + sizes.astype(_U64))


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and each text's bounds in them."""
    buf, off = utf8(col)
    n = len(buf)
    if not n:
        return np.zeros(0, _U64), np.zeros(len(off), np.int64)
    buf = _LOWER[buf]
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[:-1][off[:-1] < n]
    first[cut] = word[cut]  # a word never goes on from one text into the next
    where = np.flatnonzero(word)
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, _U64), np.zeros(len(off), np.int64)
    sizes = np.diff(np.searchsorted(where, begins), append=len(where))
    return spans_hash(buf, begins, begins + sizes), np.searchsorted(begins, off)
