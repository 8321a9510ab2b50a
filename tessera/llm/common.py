"""Shared parts: whole texts of an Arrow batch as byte blocks, vectorised words and hashes,
checkpoints in the shared folder.

Words are cut on the UTF-8 bytes with a 256-entry class table. That is exact for every word
class used here, because each of them treats all bytes from 0x80 on alike. A word's hash is a
64-bit polynomial over random byte values, taken from prefix sums, so that no loop over words
or characters runs in Python.
"""

from __future__ import annotations

import ctypes
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes that Spark sends a Python worker at once: executor and worker hold a batch and its results in several copies.
BATCH_BYTES = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def alnum_class() -> np.ndarray:
    """Bytes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text."""
    lut = np.zeros(256, dtype=bool)
    lut[0x30:0x3A] = lut[0x61:0x7B] = lut[0x41:0x5B] = True
    lut[0x80:] = True
    return lut


def nonspace_class() -> np.ndarray:
    """Bytes of the words ``[^\\x20\\x09-\\x0D]+``."""
    lut = np.ones(256, dtype=bool)
    lut[0x20] = False
    lut[0x09:0x0E] = False
    return lut


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            out = np.ones(size, dtype=np.uint64)
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
                filled += step
            _powers[name] = out
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(array: pa.Array, most: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, offsets from 0) of consecutive whole texts."""
    raw, offs = columns(array)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    trim()


def trim() -> None:
    """Gives freed memory back, which a worker that later stages use again would keep (glibc only)."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def word_bounds(data: np.ndarray, offs: np.ndarray, lut: np.ndarray):
    """First byte and byte after the last of each word, and for each text its first word's number."""
    n = len(data)
    is_word = np.zeros(n + 2, dtype=bool)
    is_word[1:-1] = lut[data]
    first = is_word[1:-1] & ~is_word[:-2]
    last = is_word[1:-1] & ~is_word[2:]
    cut = offs[(offs > 0) & (offs < n)]  # a text's end also ends its word
    if len(cut):
        first[cut] = is_word[1:-1][cut]
        last[cut - 1] = is_word[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[fold][data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(array: pa.Array, lut: np.ndarray, most: int = BLOCK_BYTES):
    """(first row, row after the last, word hashes, each text's first word) block by block."""
    for i, j, data, offs in blocks(array, most):
        starts, ends, first = word_bounds(data, offs, lut)
        yield i, j, word_hashes(data, starts, ends), first


def hash_text(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k]:first[k + 1]]."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]


def fold_of(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the number's text, modulo; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def set_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what a job writes between its steps."""
    set_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for the rest of the session (Spark reads the setting when a plan runs); a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < have <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by files in the shared folder that spark.checkpoint.dir names."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list: (node, component).

    Large-star and small-star rounds: every node hangs itself and its larger (smaller)
    neighbours under its smallest one, until no edge changes. A node's neighbours are
    never gathered in one row; the minimum is a partial aggregate. Each round's edges are
    checkpointed. No edges give no rows; self-loops give their own node.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = checkpoint(e.select("u").union(e.select(F.col("v").alias("u"))).distinct())
    e = checkpoint(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.select(F.col("u").alias("node")).join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
