"""Relational operators with the dialect's semantics, as DataFrame compositions.

Each takes and returns DataFrames; Catalyst picks the physical plan. Joins never hint a broadcast: the optimizer and
AQE broadcast a side only below spark.sql.autoBroadcastJoinThreshold, by its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.collation import fold


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asc(c: Column | str, nulls: str = "last") -> Column:
    """Ascending; NULLs go last unless told otherwise."""
    return _column(c).asc_nulls_last() if nulls == "last" else _column(c).asc_nulls_first()


def desc(c: Column | str, nulls: str = "first") -> Column:
    """Descending; NULLs go first unless told otherwise."""
    return _column(c).desc_nulls_first() if nulls == "first" else _column(c).desc_nulls_last()


def limit(df: DataFrame, n: int | str, offset: int | str = 0) -> DataFrame:
    """LIMIT and OFFSET; integral texts are taken, negatives are an error."""
    n, offset = int(n), int(offset)
    if n < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET can't be negative")
    return (df.offset(offset) if offset else df).limit(n)


def using(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """JOIN USING that keeps both copies of the key columns; NULL matches nothing."""
    condition = None
    for n in names:
        test = left[n] == right[n]
        condition = test if condition is None else condition & test
    return left.join(right, condition, how)


def semi(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """EXISTS: rows of left with a match."""
    return left.join(right, condition, "left_semi")


def anti(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """NOT EXISTS: rows of left without a match."""
    return left.join(right, condition, "left_anti")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join that deals each key of the large side over `salts` tasks; for keys with a large share of the rows.

    The small side is replicated `salts` times. AQE splits skewed joins by itself; this is for sides that AQE can't split.
    The salt is of a row's place, so equal rows are dealt like any others.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")
    salt = next(n for n in ("__salt" + "_" * k for k in range(len(large.columns) + len(small.columns) + 1)) if n not in large.columns + small.columns)
    place = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    dealt = large.withColumn(salt, F.pmod(place, F.lit(salts).cast("long")).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, salt], how).drop(salt)


def group_concat(value: Column | str, separator: str = ",", distinct: bool = False, order: Column | str | None = None, descending: bool = False) -> Column:
    """GROUP_CONCAT: NULLs are skipped, no value gives NULL. DISTINCT keeps each text's first place in the order."""
    text = _column(value).cast("string")
    key = _column(order) if order is not None else text
    pairs = F.array_agg(F.when(text.isNotNull(), F.struct(key.alias("k"), text.alias("v"))))
    texts = F.transform(F.sort_array(pairs, asc=not descending), lambda x: x["v"])
    texts = F.array_distinct(texts) if distinct else texts
    return F.when(F.size(texts) > 0, F.array_join(texts, separator))


def first_row_value(value: Column | str, order: Column | str) -> Column:
    """A value of a group's first row in the given order, for columns outside GROUP BY."""
    return F.min_by(_column(value), _column(order))


def distinct_folded(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """SELECT DISTINCT under the es collation: texts that fold alike are one; the smallest original is shown."""
    keys = [fold(c).alias(f"__{c}") if c in texts else F.col(c).alias(f"__{c}") for c in df.columns]
    return df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in df.columns)).select(df.columns)


def group_folded(df: DataFrame, text: str, *aggregates: Column) -> DataFrame:
    """GROUP BY a text under the es collation; the smallest original is shown."""
    return df.groupBy(fold(text).alias("__key")).agg(F.min(text).alias(text), *aggregates).drop("__key")


def real_divide(a: Column, b: Column) -> Column:
    """Division of reals by IEEE rules: x/0 is infinite, 0/0 is NaN, NULL stays NULL."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / F.nullif(b, F.lit(0.0)))


def int_divide(a: str, b: str) -> Column:
    """Integer division that truncates toward zero."""
    return F.expr(f"({a}) div ({b})")
