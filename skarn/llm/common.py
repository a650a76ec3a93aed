"""What the operators share: the shared folder, written intermediate tables, joins of hot keys, Arrow passes and word rules."""

from __future__ import annotations

import ctypes
import gc
import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skarn.sources.shared import delete, fresh_dir, shared_dir  # noqa: F401

#: ASCII white space, as the word rule `[^\x20\x09-\x0D]+` has it; bytes.split() splits at the same six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_SHIPPED: set[str] = set()
_LIBC = ctypes.CDLL(None)


_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. keep: beyond a scratch."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def discard(written: DataFrame) -> None:
    """Delete what materialize wrote, once nothing reads it any more."""
    delete(written.sparkSession, written.written_at)


@contextmanager
def scratch(spark: SparkSession):
    """What is materialized inside is deleted at the end, but for what is written to be kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it. Schemes that pyarrow knows, and s3a as s3."""
    return pafs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith("s3a:") else folder)


#: At most so many keys count as hot, a key needs so many rows to be one, and all of them together get so many salts.
HOT_KEYS = 1000
HOT_ROWS = 256
HOT_SALTS = 10_000


def join_hot(large: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """large joined with small, which has a row per key; rows of a hot key are dealt over many tasks.

    counts has the keys and n, the rows of large by key. The HOT_KEYS keys with the most rows are looked at; those with
    over HOT_ROWS rows get salts in proportion to their rows, HOT_SALTS in all, and their rows of small are copied to
    each salt. So small grows by HOT_SALTS rows at most, and the table of salts, which is broadcast, has HOT_KEYS rows
    at most, whatever the data. Repeated rows are dealt too, as the salt is of a row's place and not of its values.
    how is inner, left or left_anti.
    """
    top = counts.filter(F.col("n") > HOT_ROWS).select(*keys, "n").orderBy(F.desc("n")).limit(HOT_KEYS).collect()
    if not top:
        return large.join(small, keys, how)
    a_salt = max(HOT_ROWS, sum(r["n"] for r in top) / HOT_SALTS)
    rows = [(*(r[k] for k in keys), int(-(-r["n"] // a_salt))) for r in top]
    names = [f"_hot{i}" for i in range(len(keys))]
    schema = T.StructType([T.StructField(n, counts.schema[k].dataType) for n, k in zip(names, keys, strict=True)] + [T.StructField("_salts", T.IntegerType())])
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)
    salts = F.broadcast(large.sparkSession.createDataFrame(table, schema))  # from Arrow: rows of a list would go through Python workers

    def with_salts(side: DataFrame) -> DataFrame:
        same = [side[k] == salts[n] for k, n in zip(keys, names, strict=True)]
        return side.join(salts, reduce(Column.__and__, same), "left").drop(*names)

    place = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    dealt = with_salts(large).withColumn("_salt", F.coalesce(F.pmod(place, F.col("_salts").cast("long")), F.lit(0).cast("long"))).drop("_salts")
    copies = with_salts(small).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("long")))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


#: Bits of the table by which only_some and all_but pass over rows; with many more keys it tells less, but never wrongly.
MARKS = 1 << 22


def _marked(rows: DataFrame, some: DataFrame, keys: list[str], how: str) -> DataFrame:
    place = F.pmod(F.xxhash64(*keys), F.lit(MARKS).cast("long"))
    marks = some.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    words = marks.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).collect()
    table = np.zeros(MARKS // 64, dtype=np.int64)
    table[[r["word"] for r in words]] = [r["bits"] for r in words]
    frame = rows.sparkSession.createDataFrame(pa.table({"_marks": pa.array([table], pa.list_(pa.int64()))}))
    word = F.get("_marks", F.shiftright(place, 6).cast("int"))
    return rows.join(F.broadcast(frame), F.call_function("getbit", word, place.bitwiseAND(63).cast("int")) == 1, how)


def only_some(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of some, so that a join need not move the others; a few others may stay.

    The keys are marked in a table of MARKS bits, which is broadcast: half a megabyte, whatever the data.
    """
    return _marked(rows, some, keys, "left_semi")


def all_but(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that only_some leaves out."""
    return _marked(rows, some, keys, "left_anti")


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; a driver may know it by a path that workers don't."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    folder = fresh_dir(spark, "code")
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/{package.name}.zip") as sink:
        sink.write(packed.getvalue())
    context.addPyFile(f"{folder}/{package.name}.zip")
    _SHIPPED.add(context.applicationId)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def content_key(*values: Column) -> list[Column]:
    """k1, k2: 128 bits of the values. Rows of one key are alike to an operator that reads these values only."""
    return [F.xxhash64(F.lit(seed), *values, *(v.isNull() for v in values)).alias(f"k{seed}") for seed in (1, 2)]


#: Functions that empty what a worker keeps from task to task, and the operator whose tasks it ran last.
_KEPT: list[Callable[[], object]] = []
_LAST = [""]


def kept(clear: Callable[[], object]) -> None:
    """Have clear called when a worker comes to another operator's tasks."""
    _KEPT.append(clear)


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def begin(operator: str) -> None:
    """Workers serve one operator after the other; what one has kept goes before the next begins."""
    if _LAST[0] != operator:
        _LAST[0] = operator
        for clear in _KEPT:
            clear()
        gc.collect()
        give_back()


#: Operators get batches of so many bytes or so, as what they derive from a batch is many times its size.
BATCH_BYTES = 4 << 20
#: Spark's own bound, 64 MB by default: executors and workers hold several such batches at a time, outside of the heap.
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    operator = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        yield from function(_cut(batches))
        give_back()

    return run


def arrow_pass(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """One streaming pass of Arrow batches; no task holds more than a few batches of BATCH_BYTES, or of what the session has set."""
    ship_code(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set(_ARROW_BYTES, conf.get(_ARROW_BYTES, f"{BATCH_BYTES}b"))
    return df.mapInArrow(_tidy(function), schema)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []
