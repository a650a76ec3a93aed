"""Copy-on-write tables: a table is an immutable list of Parquet directories with a schema and constraints; DML makes its next version.

An INSERT writes its rows to a directory of their own and checks those rows only, against the keys that are there; other
statements write the table anew. So lineage doesn't grow, versions outlive lost executors, and older versions serve
open snapshots until they are vacuumed. Checks are aggregates, semi- and anti-joins over all rows concerned; no row
visits the driver but counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.errors import CheckViolation, ColumnNotFound, ConstraintViolation, ForeignKeyParentViolation, ForeignKeyViolation, NotNullViolation, NotSupported, TableNotFound, UniqueViolation
from skarn.sources.shared import delete, fresh_dir


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    auto_increment: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "NO ACTION"
    name: str | None = None


@dataclass(frozen=True)
class Constraint:
    kind: str  # primary key, unique, check
    columns: tuple[str, ...] = ()
    expression: str = ""
    name: str | None = None
    where: str | None = None


@dataclass(frozen=True)
class Table:
    columns: tuple[ColumnDef, ...]
    data: DataFrame
    constraints: tuple[Constraint, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    next_id: int = 1
    indexes: dict[str, str] = field(default_factory=dict)
    paths: tuple[str, ...] = ()

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ColumnNotFound(f"no column {name}")

    def is_key(self, *columns: str) -> bool:
        return any(k.kind in ("primary key", "unique") and not k.where and k.columns == columns for k in self.constraints)


def schema_of(columns: tuple[ColumnDef, ...]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{c.name}` {c.type}" for c in columns))


class Versions:
    """Where versions are written: below the session's folder, or else the shared one."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder, self.written = spark, folder, set()

    def write(self, data: DataFrame) -> str:
        path = fresh_dir(self.spark, "table") if self.folder is None else f"{self.folder}/{fresh_dir(self.spark, 'table').rpartition('/')[2]}"
        data.write.parquet(path)
        self.written.add(path)
        return path

    def read(self, schema: T.StructType, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def keep(self, data: DataFrame) -> DataFrame:
        return self.read(data.schema, self.write(data))

    def rewritten(self, table: Table, data: DataFrame) -> Table:
        """The table with other rows, or rows of another schema."""
        path = self.write(data)
        return replace(table, data=self.read(data.schema, path), paths=(path,))

    def appended(self, table: Table, path: str) -> Table:
        """The table with the rows of one more directory."""
        paths = (*table.paths, path)
        return replace(table, data=self.read(table.data.schema, *paths), paths=paths)

    def drop(self, path: str) -> None:
        self.written.discard(path)
        delete(self.spark, path)

    def vacuum(self, kept: set[str]) -> int:
        """Delete the directories of versions that nothing refers to any more."""
        gone = self.written - kept
        for path in gone:
            self.drop(path)
        return len(gone)


def not_null(data: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a NULL where none may be."""
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull()
    return data.filter(bad)


def _keyed(data: DataFrame, names: list[str], where: str | None) -> DataFrame:
    """Rows that a unique constraint looks at; a key with a NULL never clashes."""
    rows = data.filter(where) if where else data
    for n in names:
        rows = rows.filter(F.col(n).isNotNull())
    return rows


def duplicates(data: DataFrame, names: list[str], where: str | None = None) -> DataFrame:
    """Keys that occur more than once."""
    return _keyed(data, names, where).groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")


def taken_keys(fresh: DataFrame, old: DataFrame, names: list[str], where: str | None = None) -> DataFrame:
    """Keys of fresh rows that old rows have; the few fresh rows are the side that Spark may broadcast."""
    keys = _keyed(fresh, names, where).select(*names)
    return _keyed(old, names, where).select(*names).join(keys, names, "left_semi")


def check_failures(data: DataFrame, expression: str) -> DataFrame:
    """Rows for which a CHECK is FALSE or NULL."""
    return data.filter(~F.coalesce(F.expr(expression).cast("boolean"), F.lit(False)))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key has no parent; NULL keys pass."""
    keys = parent.select(F.col(parent_column).alias("__parent"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def _fail_if_any(rows: DataFrame, kind: type[ConstraintViolation], what: str) -> None:
    if not rows.isEmpty():
        raise kind(what)


def validate(table: Table, name: str, tables: dict[str, Table], fresh: DataFrame | None = None) -> None:
    """Check all rows, or the fresh rows of a table whose other rows (table.data without them) are known to be right."""
    rows = table.data if fresh is None else fresh
    required = [c.name for c in table.columns if not c.nullable]
    if required:
        _fail_if_any(not_null(rows, required), NotNullViolation, f"NULL in a NOT NULL column of {name}")
    for c in table.constraints:
        if c.kind == "check":
            _fail_if_any(check_failures(rows, c.expression), CheckViolation, f"CHECK of {name} fails")
        else:
            keys = list(c.columns)
            _fail_if_any(duplicates(rows, keys, c.where), UniqueViolation, f"duplicate {c.kind} in {name}")
            if fresh is not None and table.paths:
                _fail_if_any(taken_keys(fresh, table.data, keys, c.where), UniqueViolation, f"duplicate {c.kind} in {name}")
            if c.kind == "primary key":
                _fail_if_any(not_null(rows, keys), NotNullViolation, f"NULL in the primary key of {name}")
    for k in table.foreign_keys:
        if k.parent not in tables:
            raise TableNotFound(f"no table {k.parent}")
        parent = tables[k.parent].data.select(k.parent_column)
        if fresh is not None and k.parent == name:
            parent = parent.unionByName(fresh.select(k.parent_column))
        _fail_if_any(orphans(rows, k.column, parent, k.parent_column), ForeignKeyViolation, f"{name}.{k.column} has no row in {k.parent}")


def in_columns(table: Table, rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows in the table's columns: cast, missing ones NULL."""
    given = rows.toDF(*names)
    return given.select(*((F.col(f"`{c.name}`") if c.name in names else F.lit(None)).cast(c.type).alias(c.name) for c in table.columns))


def with_ids(table: Table, column: str, path: str, versions: Versions) -> tuple[str, int, int | None]:
    """Written rows with the missing values of an AUTO_INCREMENT column filled: their new path, the next id and the first new one.

    Rows are numbered by file and place in it: what was written doesn't change, however often it is read. The files'
    offsets are a table too, of a row per file.
    """
    schema = table.data.schema
    rows = versions.read(schema, path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    missing = rows.filter(F.col(column).isNull())
    n_missing, top = rows.agg(F.sum(F.col(column).isNull().cast("int")), F.max(column)).first()
    following = max(table.next_id + (n_missing or 0), (top or 0) + 1)
    if not n_missing:
        return path, following, None
    sizes = missing.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__file", before.alias("__before"))
    # rows with an id of their own don't count, so a file's missing rows are ranked among themselves
    rank = F.row_number().over(Window.partitionBy("__file").orderBy("__row"))
    numbered = missing.withColumn("__rank", rank).join(offsets, "__file").withColumn(column, (F.col("__before") + F.col("__rank") + F.lit(table.next_id - 1)).cast(table.column(column).type))
    out = versions.write(rows.filter(F.col(column).isNotNull()).select(schema.names).unionByName(numbered.select(schema.names)))
    versions.drop(path)
    return out, following, table.next_id


def updated(data: DataFrame, assignments: dict[str, Column], where: Column) -> DataFrame:
    """UPDATE: where the predicate is TRUE each assigned column takes its expression over the old row."""
    hit = data.filter(where).select(*(assignments[c].cast(t).alias(c) if c in assignments else F.col(f"`{c}`") for c, t in data.dtypes))
    return hit.unionByName(remaining(data, where)) if assignments else data


def remaining(data: DataFrame, where: Column) -> DataFrame:
    """DELETE: the rows for which the predicate isn't TRUE."""
    return data.filter(~F.coalesce(where.cast("boolean"), F.lit(False)))


MAX_CASCADE = 10


def deleted(tables: dict[str, Table], name: str, doomed: DataFrame, versions: Versions, depth: int = 0) -> dict[str, Table]:
    """Tables after a DELETE of `doomed` rows with the foreign keys' actions carried out."""
    if depth > MAX_CASCADE:
        raise ForeignKeyParentViolation(f"cascade deeper than {MAX_CASCADE}")
    out = dict(tables)
    for child_name, child in tables.items():
        for key in child.foreign_keys:
            if key.parent != name:
                continue
            gone = doomed.select(F.col(key.parent_column).alias("__gone")).filter("__gone IS NOT NULL").distinct()
            hit = out[child_name].data.join(gone, F.col(key.column) == F.col("__gone"), "left_semi")
            action = key.on_delete.upper()
            if action == "CASCADE":
                hit = versions.keep(hit)
                if not hit.isEmpty():
                    out = deleted(out, child_name, hit, versions, depth + 1)
                    rest = out[child_name].data.join(gone, F.col(key.column) == F.col("__gone"), "left_anti")
                    out[child_name] = versions.rewritten(out[child_name], rest)
            elif action == "SET NULL":
                if not child.column(key.column).nullable:
                    raise ConstraintViolation(f"{child_name}.{key.column} can't be NULL")
                marked = out[child_name].data.join(gone, F.col(key.column) == F.col("__gone"), "left")
                fresh = marked.select(*(F.when(F.col("__gone").isNotNull(), F.lit(None)).otherwise(F.col(c)).cast(t).alias(c) if c == key.column else F.col(c) for c, t in out[child_name].data.dtypes))
                out[child_name] = versions.rewritten(out[child_name], fresh)
            elif action in ("NO ACTION", "RESTRICT"):
                _fail_if_any(hit, ForeignKeyParentViolation, f"rows of {child_name} refer to {name}")
            else:
                raise NotSupported(f"ON DELETE {action}")
    return out


def column_statistics(data: DataFrame, names: list[str] | None = None) -> DataFrame:
    """ANALYZE: exact row count and exact number of distinct values, a row per column."""
    names = names or data.columns
    counts = data.agg(F.count("*").alias("n"), *(F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"d{i}").alias("ndv")) for i, c in enumerate(names)))
    return counts.select(F.inline(each))
