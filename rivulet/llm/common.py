"""What several operators share: checkpoints, input columns, word shingles."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII upper case to lower case; other letters stay as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE_WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Rows of a table of numbers that go to one file at least.
ROWS_A_FILE = 1 << 17


def checkpoint(df: DataFrame, most: int | None = None, each: int = ROWS_A_FILE) -> DataFrame:
    """Cut the lineage through a table in the folder that spark.checkpoint.dir names, which outlives executors.

    A folder of our own is set only where the session names none and runs in one process (tests);
    on a cluster a RuntimeError asks for a shared one. The
    tables are compressed, so they take a fraction of what an RDD's checkpoint does; they are
    removed when the driver ends.

    most: what the table's rows, or those read for it, are at most, where the caller knows; it is
    then written by a task for `each` of them, not by one for each shuffle partition. A local file
    costs the executor's JVM two processes (chmod for it and for its checksum), each of which is
    the whole JVM until it has begun.
    """
    if most is not None:
        df = df.coalesce(most // each + 1)
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rivulet-"))
        folder = context._jsc.sc().getCheckpointDir()
    path = f"{folder.get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table if Spark still runs; what a stopped session leaves is its cluster's to clear."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that was freed back to the system: a worker that waits would keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """A function over batches that leaves no freed memory with its worker."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        trim()

    return run


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: some texts are megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with (names don't differ by case)."""
    out = "_"
    while any(c.lower().startswith(out) for df in frames for c in df.columns):
        out = f"_x{out}"
    return out


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all 64 bits (a finaliser; one to one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    _BYTE_CODES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)


def _powers(n: int) -> np.ndarray:
    """The powers of an odd number, modulo 2^64."""
    p = np.full(n, 0xD1342543DE82EF95, np.uint64)
    if n:
        p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=np.uint64)


_POWERS = _powers(1 << 10)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of whole texts, and each text's offset in them.

    All bytes of a batch are hashed at once: a word's hash is the sum of its bytes' codes times
    powers of an odd number, finished by a mixing step.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"\n".join([b"", *raw, b""]).translate(LOWER), np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    docs = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    if not len(starts):
        return np.empty(0, np.uint64), docs
    lengths = ends - starts
    at = np.arange(len(buf)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(buf)]])))
    powers = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
    with np.errstate(over="ignore"):
        codes = np.where(space, np.uint64(0), _BYTE_CODES[buf] * powers[np.where(space, 0, at)])
        total = np.cumsum(codes, dtype=np.uint64)
        return mixed(total[ends - 1] - total[starts - 1] + lengths.astype(np.uint64) * _MIX), docs


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text, and each text's offset in them.

    A text of fewer words than a shingle has its whole word sequence as one shingle; a text
    without words has none.
    """
    words, docs = word_hashes(texts)
    count = np.diff(docs)
    of = np.repeat(np.arange(len(texts)), count)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        for w in range(1, width):  # short texts
            short = np.flatnonzero(count == w)
            if len(short):
                h = np.full(len(short), w, np.uint64)
                for k in range(w):
                    h = mixed(h * _MIX + words[docs[short] + k])
                parts.append(h)
                owners.append(short)
        n = len(words) - width + 1
        if n > 0:
            h = np.full(n, width, np.uint64)
            for k in range(width):
                h = mixed(h * _MIX + words[k : n + k])
            whole = of[:n] == of[width - 1 :]
            parts.append(h[whole])
            owners.append(of[:n][whole])
    if not parts:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))
