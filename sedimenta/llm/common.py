"""Helpers shared by the text operators: words, 64-bit hashes and the corpus count exchange.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; on UTF-8 bytes that is ``bytes.split()``.
Hashes have 64 bits: two different keys count as equal with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, about.
HASH_BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte value.
BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
#: Odd, and 3 modulo 4, so that all its powers can be undone.
BASE = 0xD1342543DE82EF97


class Powers:
    """BASE**i and BASE**-i modulo 2**64, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        return cls.up, cls.down


def hash_block(values: list[bytes]) -> list[np.ndarray]:
    """A hash of each word of each text.  A word is the polynomial of its bytes' numbers at BASE; the sums over all bytes so far give
    those of all words at once."""
    data = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    up, down = Powers.of(len(data))
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.cumsum(BYTES[data] * up[: len(data)])
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        words = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.cumsum([len(v) + 1 for v in values])[:-1]
    return np.split(words, np.searchsorted(starts, cuts))


def hashed_texts(values: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text, in order."""
    out: list[np.ndarray] = []
    block, size = [], 0
    for v in values:
        block.append(v)
        size += len(v)
        if size >= HASH_BLOCK:
            out += hash_block(block)
            block, size = [], 0
    return out + (hash_block(block) if block else [])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads the sums that :func:`windows` makes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` values, by doubling: h[2k](i) = h[k](i) * M**k + h[k](i + k)."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, length, out, done, power = hashes, 1, None, 0, MULTIPLIER
        while True:
            if size & length:
                if out is None:
                    out, done = part, length
                else:  # the longer run so far goes to the right
                    n = len(hashes) - (done + length) + 1
                    out = part[:n] * power_of(done) + out[length : length + n]
                    done += length
            if done == size:
                return mix(out[: len(hashes) - size + 1])
            n = len(part) - length
            part = part[:n] * power + part[length : length + n]
            length, power = 2 * length, power * power


def power_of(n: int) -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), n, 1 << 64))


def texts(column: pa.ChunkedArray | pa.Array):
    """UTF-8 bytes of each text; null: empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends, at the latest."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "sedimenta-checkpoints")
    path = f"{base.rstrip('/')}/sedimenta-{uuid.uuid4().hex}"
    at, fs = hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: With this setting Spark deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame) -> DataFrame:
    """Writes the frame as a table in the shared folder and reads it back: the lineage ends there, and so do the shuffle files before it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(f"{path}/table")
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(f"{path}/table")
    _PATHS[id(out)] = (weakref.ref(out, lambda _, i=id(out): _PATHS.pop(i, None)), path)
    return out


_PATHS: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of materialised frames that nothing to come will read, lost tasks included."""
    for df in frames:
        at, fs = hadoop(df.sparkSession, _PATHS.pop(id(df))[1])
        fs.delete(at, True)


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns of these names (in any case of letters) renamed, and what renames them back."""
    back = {}
    for c in df.columns:
        if c.lower() in names:
            back[free_name(f"__aside_{c}", df)] = c
            df = df.withColumnRenamed(c, list(back)[-1])
    return df, lambda out: out.withColumnsRenamed(back)


_KEPT: dict[str, Callable[[], object]] = {}


def begin(owner: str, forget: Callable[[], object] | None = None) -> None:
    """At the start of a task in Python: lets go of what other operators' tasks have kept in this worker.  forget: lets go of what the
    owner's tasks keep for one another."""
    for other in [o for o in _KEPT if o != owner]:
        _KEPT.pop(other)()
    if forget is not None:
        _KEPT[owner] = forget


#: Bytes of a batch that goes to a Python worker, at most.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has Spark send batches of bounded size to Python: 10,000 rows with long texts are more than a worker should hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that is free back to the machine: a Python worker lives on between tasks, beside its executor's own memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def text_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def in_groups(docs: DataFrame, id_col: str, text: str, size: tuple[int, int], target: int = 8 << 20) -> tuple[DataFrame, int]:
    """Deals documents into groups of about ``target`` bytes (column __grp) by a hash of id and text, so that neither a repeated id nor a
    repeated text falls into one group."""
    rows, total = size
    groups = max(1, math.ceil(total / target), math.ceil(rows / 100_000))
    return docs.withColumn("__grp", F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(groups))), groups


def spread(keys: np.ndarray) -> np.ndarray:
    """One to one, and even in the upper bits, by which keys are dealt: smallest hashes, as anchors are, would nearly all fall into the
    first bucket."""
    with np.errstate(over="ignore"):
        return keys.astype(np.uint64) * MULTIPLIER


#: Rows of a narrow table that is broadcast at most.
MOST_BROADCAST = 200_000
#: Keys that count as hot at most: those with more than this part of all rows.
MOST_HOT = 10_000


def with_one(rows: DataFrame, ones: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """rows, each with the row of ``ones`` of its key, if any; ones: narrow, one row for each key.  Both are tables.

    A small ``ones`` is broadcast (``bound``: a number that it has no more rows than).  Else the keys with more than 1/MOST_HOT of the
    rows are joined by a broadcast of just theirs, fewer than MOST_HOT, and the other keys by a shuffle: no key fills a task."""
    if (ones.count() if bound is None else bound) <= MOST_BROADCAST:
        return rows.join(F.broadcast(ones), key, "left")
    least = rows.count() / MOST_HOT
    hot = F.broadcast(materialised(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(key)))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(ones.join(hot, key, "left_semi")), key, "left")
    return often.unionByName(rows.join(hot, key, "left_anti").join(ones, key, "left"))


# The count exchange.  Each group of documents asks once for each distinct key that it holds; a bucket of keys adds up what all
# groups hold and answers each group in its own order.  No key, however frequent, has more than one entry for each group.

REQUEST = "__grp long, bucket int, keys binary, counts binary"
REPLY = "__grp long, bucket int, round int, answer binary"


def request_rows(group: int, keys: np.ndarray, counts: np.ndarray, buckets: int, first: int = 0, low: int = 0) -> list[tuple]:
    """keys: sorted and distinct.  Buckets are ranges of keys, so that answers in bucket order are in key order.  low: bits that are
    zero in all keys and needn't be sent."""
    if not len(keys):
        return []
    bucket = bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        own = counts[a:b]
        out.append((group, first + int(bucket[a]), packed(keys[a:b] >> np.uint64(low)), b"" if (own == 1).all() else counted(own)))
    return out


def counted(n: np.ndarray) -> bytes:
    """Counts in a byte each, the large ones apart, compressed."""
    large = n > 254
    return zlib.compress(np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<u4").tobytes(), 1)


def uncounted(data: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(data)
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=size)
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps between them, each in as few bytes as the largest step needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + body.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width, body = data[0], np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def request_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"__grp": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


def reply_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"__grp": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int32()), "round": pa.array(cols[2], pa.int32()), "answer": pa.array(cols[3], pa.binary())})


def added_up(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups, ends of their requests, distinct keys, their total counts, and the place of each asked key among them."""
    groups = table.column("__grp").to_pylist()
    keys = [unpacked(k.as_py()) for k in table.column("keys")]
    counts = [uncounted(b, len(k)) if (b := c.as_py()) else np.ones(len(k), np.int64) for k, c in zip(keys, table.column("counts"), strict=True)]
    ends = np.cumsum([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return groups, ends, distinct, total, place


def replies(requests: DataFrame, encode: Callable[[np.ndarray], bytes], number: int = 0) -> DataFrame:
    """encode: makes the answer from the total counts of the keys asked for."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        groups, ends, _, total, place = added_up(table)
        parts = np.split(total[place], ends[:-1])
        return reply_table([(g, bucket, number, encode(p)) for g, p in zip(groups, parts, strict=True)])

    return requests.groupBy("bucket").applyInArrow(answer, REPLY)


def flags(total: np.ndarray) -> bytes:
    """Whether each key was found twice or more."""
    return (total >= 2).astype(np.uint8).tobytes()


def answers(table: pa.Table, number: int, dtype: str) -> np.ndarray:
    """All answers of a round to this group, in key order."""
    rows = sorted((b, a) for b, r, a in zip(table.column("bucket").to_pylist(), table.column("round").to_pylist(), table.column("answer").to_pylist(), strict=True) if r == number)
    return np.frombuffer(b"".join(a for _, a in rows), dtype)
