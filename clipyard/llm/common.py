"""Reading the tables, cutting lineage in the shared folder, and vectorised byte hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes the shuffle files of an execution at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a folder of our own, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-clipyard-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def scratch(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation. last: the files of its shuffles go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    free = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if last else free)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, free)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives freed memory back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if give:
        give(0)


def tidy(run: Callable) -> Callable:
    """run, after which the worker gives freed memory back: idle workers stay beside those of other stages."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def row_key() -> list:
    """Join key of a row that keeps rows with the same doc_id but other texts apart. Rows equal in both share it, and share their result."""
    return [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("k_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k_text")]


FILTER_BITS = 1 << 22


def only_near(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose long `key` may be among those of keys: all that are, and a few others, by a bitmap of fixed size. Spares a join from shuffling rows that have no partner."""
    import pyarrow as pa

    block = 1 << 12
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    blocks = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / block).alias("b")).agg(F.collect_set((F.col("s") % block).cast("int")).alias("s"))
    bits = np.zeros(FILTER_BITS, bool)
    for r in blocks.collect():  # at most FILTER_BITS numbers, whatever the corpus
        bits[r["b"] * block + np.array(r["s"])] = True
    held = df.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        own = np.unpackbits(held.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(own[b.column("slot_").to_numpy()])).drop_columns(["slot_"])

    return df.withColumn("slot_", slot).mapInArrow(tidy(run), df.schema)


# --- polynomial hashes of byte strings, modulo 2**64 -------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 14)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, np.uint64))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _INVERSE, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] is the polynomial sum over data[:i]; data holds bytes, or mixed 64-bit symbols."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever that string stands."""
    return mix((prefix[end] - prefix[start]) * _inverses[start])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of single-spaced bytes."""
    if not raw:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(data == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.append(gaps, len(data))
    return span_hash(prefix_hash(data), start, end), start, end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; of the whole sequence where it has fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    at = np.arange(len(words) - n + 1)
    return span_hash(prefix_hash(words), at, at + n)
