"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.staging import stage as stage_table  # noqa: F401 (used by the operators)
from sightline.sources.staging import unstage as drop_stage  # noqa: F401

#: Bytes that are not word characters of the "alphanumeric" word rule, mapped to a space; A-Z to a-z.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches of texts hold about ``size`` bytes, unless the session asks for less.

    Batches are bounded by rows otherwise, and ten thousand long texts fill an executor's memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def release(spark: SparkSession) -> None:
    """Collect garbage in the driver: Spark deletes the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def id_bucket_py(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def crc_table_sql() -> str:
    """DuckDB SQL for the one row ``crc_steps``: the 256 steps of CRC-32, for ``crc_sql``."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    inner = "n::BIGINT AS c0"
    for k in range(8):
        inner = f"*, {step.format(f'c{k}')} AS c{k + 1} FROM (SELECT {inner}" + (" FROM range(256) r(n)" if k == 0 else "") + ")"
    return f"SELECT list(c8 ORDER BY c0) AS crc_steps FROM (SELECT {inner})"


def crc_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, beside the column of ``crc_table_sql``; null for null."""
    steps = f"list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crc_steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_batch(batch: pa.RecordBatch, text: str, max_bytes: int = 2 << 20):
    """Slices of a batch with about ``max_bytes`` of text each, so that working memory is bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def rebatch(batches, rows: int):
    """The same rows in batches of at least ``rows`` (but the last), for work whose cost is per call."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: What a worker keeps from task to task: name of the operator, function that drops it.
KEPT: dict[str, object] = {}


def keep(operator: str, drop) -> None:
    """Note what drops an operator's tables. Functions of modules call it: one that is sent to the workers holds a copy of ``KEPT``."""
    KEPT[operator] = drop


def give_back(batches, operator: str | None = None):
    """Pass batches on, now and then returning freed memory to the system: Python workers live on from task to task.

    What other operators' tasks have kept in this worker is dropped first.
    """
    for name in [k for k in KEPT if k != operator]:
        KEPT.pop(name)()
    for i, batch in enumerate(batches):
        yield batch
        if i % 8 == 7:
            trim()
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library only
    if give:
        give(0)
