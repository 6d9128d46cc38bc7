"""Helpers of the training-data operators: durable intermediate tables and text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract of this package: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_fallback_dirs: dict[str, str] = {}

#: Bytes of an Arrow batch between the JVM and Python; long texts would make the usual 10,000 rows too large.
BATCH_BYTES = 8 << 20


#: Bytes that a task gathers before it writes them to an intermediate table.
ROW_GROUP_BYTES = 32 << 20


#: How far the driver's heap may grow before its garbage is collected and given back.
HEAP_GROWTH = 48 << 20

_heap_after: dict[str, int] = {}


def give_back(spark: SparkSession) -> str | None:
    """The driver gives free memory back to the system: garbage of its heap, where that grew, and what its JIT compiler and plans have freed.

    Returns what the JVM says of its native heap; None where it has no such command (JDK before 17.0.9, other systems).
    """
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() >= _heap_after.get(app, 0) + HEAP_GROWTH:
        jvm.java.lang.System.gc()
        _heap_after[app] = runtime.totalMemory()
    leave()
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    arguments[0], arguments[1] = command, "systemTrimNativeHeap"
    with contextlib.suppress(Py4JError):
        # the server's class is internal to the JVM, so its public interface is called
        invoke = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        return invoke[0].invoke(beans, arguments)
    return None


def settle(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are bounded more tightly; the driver gives free memory back."""
    give_back(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


_working_on: list[str] = []
_cleaners: dict[str, Callable[[], None]] = {}


def enter(kind: str) -> None:
    """Called by a kernel at its start: a Python worker that did other work before gives that memory back."""
    if _working_on == [kind]:
        return
    for name, clean in _cleaners.items():
        if name != kind:
            clean()
    _working_on[:] = [kind]
    leave()


def leave() -> None:
    """Called by a kernel at its end: an idle Python worker gives free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only on a single machine may that setting be absent (tests); then a local folder is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback_dirs:
            _fallback_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        base = _fallback_dirs[app]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    settle(spark)
    path = shared_dir(spark, tag)
    writer = df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP_BYTES)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, under fixed names; other columns stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, at least one row; whole texts only."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binaries(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each piece of ``data``; ``ends`` has the places between them, from 0 to the end."""
    if isinstance(data, np.ndarray):
        data = np.ascontiguousarray(data)
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one array")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def joined_bytes(values: pa.Array) -> np.ndarray:
    """All bytes of a binary array without nulls, one after the other, without a copy."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (fixed multipliers of a public mixer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words longer than this are hashed as a whole by BLAKE2b.
_LONG_WORD = 64
_KEEP = np.asarray([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _fingerprints(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, seed: int) -> np.ndarray:
    """64-bit keyed hashes of the byte strings raw[start:end], eight bytes at a time, each step through the mixer."""
    data = np.zeros(len(raw) + 8, dtype=np.uint8)
    data[: len(raw)] = raw
    if lower:
        data += ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    key = mix64(np.asarray([seed + 1], dtype=np.uint64))[0]
    with np.errstate(over="ignore"):
        code = mix64((eight[start] & _KEEP[np.minimum(size, 8)]) ^ (key + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        more = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        for at in range(8, _LONG_WORD, 8):
            more = more[size[more] > at]
            if not len(more):
                break
            code[more] = mix64(code[more] * np.uint64(0xD6E8FEB86659FD93) + (eight[start[more] + at] & _KEEP[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=int(key).to_bytes(8, "little")).digest()
        code[i] = np.frombuffer(digest, dtype="<u8")[0]
    return code


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Words of all rows of a buffer: byte start, byte end, first word of each row, then a 64-bit fingerprint per seed.

    Separators never occur inside a UTF-8 sequence, so bytes can be compared. A fingerprint depends on the
    word's bytes and the seed alone; those of two seeds are independent. ``lower`` folds A-Z first.
    """
    ink = ~_IS_SPACE[raw]
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    filled = np.diff(offsets) > 0
    begin[offsets[:-1][filled]] = ink[offsets[:-1][filled]]
    stop[offsets[1:][filled] - 1] = ink[offsets[1:][filled] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return (start, end, np.searchsorted(start, offsets), *(_fingerprints(raw, start, end, lower, seed) for seed in seeds))


def chain(code: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive words from each place (shorter at the end of the array: not defined)."""
    out, have = None, 0
    level, width = code, 1
    with np.errstate(over="ignore"):
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                if out is None:
                    out, have = level.copy(), width
                else:
                    later = np.zeros_like(level)
                    later[: max(0, len(level) - have)] = level[have:]
                    out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + later)
                    have += width
            if n >> (bit + 1):
                later = np.zeros_like(level)
                later[: max(0, len(level) - width)] = level[width:]
                level = mix64(level * np.uint64(0xA0761D6478BD642F) + later + np.uint64(bit))
                width *= 2
    return out
