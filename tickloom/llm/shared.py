"""What the operators share: the folder for intermediate tables, and reading texts as bytes.

Hashes are polynomial over bytes (or over word hashes), taken from one prefix sum
modulo 2^64, so that a whole Arrow batch is hashed by a few numpy calls; a final
mixing step (splitmix64) spreads them. Nothing here loops over rows or words.
"""

from __future__ import annotations

import atexit
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64 = (1 << 64) - 1
P_BYTE, P_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes hashed at a time: temporary arrays of eight times this stay in the cache.
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
T_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Bytes of tokens that white space separates.
IS_TOKEN = np.ones(256, dtype=bool)
IS_TOKEN[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept by the process, since every batch asks for them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        k, step = 1, base & M64
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(step)
            k, step = 2 * k, step * step & M64
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64 bits."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span lies."""
    return (sums[ends] - sums[starts]) * powers(inverse(base), len(sums))[starts]


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each (a longer row is alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of that kind within rows, and the number in each row."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    on = kind[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    off_before = np.ones(n, dtype=bool)
    np.logical_not(on[:-1], out=off_before[1:])
    starts = np.flatnonzero(on & (off_before | cut[:-1]))
    off_after = np.ones(n, dtype=bool)
    np.logical_not(on[1:], out=off_after[:-1])
    ends = np.flatnonzero(on & (off_after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(col: pa.Array | pa.ChunkedArray, lower: bool = True, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the column in order, and the number in each row."""
    buf, off = text_bytes(col)
    hs, ns = [], []
    for a, b in row_slices(off):
        o = off[a : b + 1] - off[a]
        part = buf[off[a] : off[b]]
        starts, ends, n = spans(part, o, kind)
        sums = prefix_sums(T_BYTE[LOWER[part] if lower else part], P_BYTE)
        hs.append(mix(span_hash(sums, starts, ends, P_BYTE), 1))
        ns.append(n)
    return (np.concatenate(hs), np.concatenate(ns)) if hs else (np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine, as in tests."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    have = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
    atexit.register(shutil.rmtree, have[7:], True)
    spark.conf.set("spark.checkpoint.dir", have)
    return have


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back. An executor lost later costs a reread only.

    The files go when the application ends, or by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickloom_path = path
    return out


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    fs, at = _files(df.sparkSession, df._tickloom_path)
    fs.delete(at, True)


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def integer_id(df: DataFrame, name: str = "doc_id") -> Column:
    """The id column as bigint; ids of another type are refused, for results carry integers."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"{name} must be an integer column, not {kind.simpleString()}")
    return F.col(quoted(name)).cast("bigint")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ...: whatever their names were, an operator's own can't clash with them."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def columns(df: DataFrame) -> list[Column]:
    """All columns by their names, whatever is in these."""
    return [F.col(quoted(c)) for c in df.columns]


#: Rows in an Arrow batch: texts are long, and 10,000 of them are held several times over on the way to Python.
BATCH_ROWS = 2000


def give_back() -> None:
    """Memory that only waits for reuse goes back to the system, for idle workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean_group(run):
    """A function of whole groups that gives memory back after each."""

    def lean(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        give_back()
        return out

    lean.__signature__ = inspect.signature(run)
    return lean


def _lean(run):
    """The batch function; memory is given back when a partition is done."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":  # Spark's default
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(_lean(run), schema)
