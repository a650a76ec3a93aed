"""The engine's API: SQL of the dialect over Spark.

    session = Session(spark).attach("/data/sf0.1")
    session.query("SELECT n_name FROM nation ORDER BY n_name").show()
    session.execute("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, name TEXT NOT NULL)")

`query` gives a DataFrame, `execute` a DataFrame, an Affected or None, `run` the results of a script, `prepare` a
statement with `?` parameters. Tables made here are copy-on-write (`skarn.operators.tables`); a transaction is a
pointer to the tables as they were.

Tables are named database.schema.table; a short name is looked up in the session's database along its search path, a
name of two parts by schema, or by database if there is no such schema. Attached Parquet tables are in the default
database. Tables belong to one session, so all isolation levels give the same results and no lock is waited for.
"""

from __future__ import annotations

import itertools
import re
import time
from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import errors as er
from skarn.errors import EngineError, NotFound, SyntaxFault  # noqa: F401
from skarn.operators import tables as tb
from skarn.plans.dialect import Rewriter, Unsupported, split_statements, tokens
from skarn.sources import tables as sources

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DATABASE, SCHEMA = "default", "public"
VERSION = "8.0.36-skarn"
_NUMBERS = itertools.count(1)


@dataclass(frozen=True)
class Affected:
    count: int
    last_insert_id: int | None = None


@dataclass
class Settings:
    autocommit: bool = True
    strict_mode: bool = True
    sql_mode: str = "STRICT_TRANS_TABLES"
    on_error: str = "rollback_statement"
    compat: str = "standard"
    collation: str = ""
    search_path: str = SCHEMA
    transaction_isolation: str = "repeatable read"
    lock_timeout: int = 30

    def active_collation(self) -> str:
        return self.collation or ("es" if self.compat == "mysql" else "binary")

    def path(self) -> list[str]:
        return [p.strip().strip("'\"") for p in self.search_path.split(",") if p.strip()]


_CHOICES = {
    "on_error": ("rollback_statement", "rollback_transaction", "savepoint", "ignore"), "compat": ("standard", "mysql", "postgresql"), "collation": ("binary", "es", ""),
    "transaction_isolation": ("read uncommitted", "read committed", "repeatable read", "serializable"),
}
_STRICT = ("STRICT_TRANS_TABLES", "STRICT_ALL_TABLES", "TRADITIONAL")


@dataclass
class Prepared:
    session: Session
    sql: str

    def execute(self, *params: Any) -> Any:
        return self.session.execute(self.sql, params)


@dataclass
class _State:
    tables: dict[str, tb.Table] = field(default_factory=dict)
    schemas: tuple[tuple[str, str], ...] = ((DATABASE, SCHEMA),)

    def databases(self) -> list[str]:
        return sorted({d for d, _ in self.schemas})


class Session:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.settings = spark, Settings()
        self.warnings: list[str] = []
        self.number, self.last_insert_id, self.row_count, self.database = next(_NUMBERS), 0, -1, DATABASE
        self.statements: Counter[str] = Counter()
        self._state, self._begun, self._savepoints = _State(), None, {}
        self._versions = tb.Versions(spark, folder)
        self._views: dict[str, DataFrame] = {}

    # -- sources

    def attach(self, directory: str, names: tuple[str, ...] = DRIVER_TABLES) -> Session:
        """Make the Parquet tables of a directory known by their names; they are scanned when queried."""
        for name in names:
            self.register(name, sources.table(self.spark, directory, name))
        return self

    def register(self, name: str, data: DataFrame) -> Session:
        self._views[f"{DATABASE}.{SCHEMA}.{name}"] = data
        return self

    def _key(self, parts: list[str], new: bool = False) -> str:
        """database.schema.table of a name; new: of a table to be made, else of one that is there, if any is."""
        known = {*self._state.tables, *self._views}
        if len(parts) > 3:
            raise SyntaxFault(f"{'.'.join(parts)} has more than three parts")
        if len(parts) == 3:
            if parts[0] not in self._state.databases():
                raise er.DatabaseNotFound(f"no database {parts[0]}")
            return ".".join(parts)
        if len(parts) == 2:
            if (self.database, parts[0]) not in self._state.schemas and (parts[0], SCHEMA) in self._state.schemas:
                return f"{parts[0]}.{SCHEMA}.{parts[1]}"
            if new and (self.database, parts[0]) not in self._state.schemas:
                raise er.SchemaNotFound(f"no schema {parts[0]}")
            return f"{self.database}.{'.'.join(parts)}"
        path = self.settings.path()
        if new:
            return f"{self.database}.{path[0]}.{parts[0]}"
        found = [k for schema in path if (k := f"{self.database}.{schema}.{parts[0]}") in known]
        attached = f"{DATABASE}.{SCHEMA}.{parts[0]}"
        return found[0] if found else attached if attached in self._views else f"{self.database}.{path[0]}.{parts[0]}"

    def _frame(self, parts: list[str]) -> DataFrame | None:
        key = self._key(parts)
        return self._state.tables[key].data if key in self._state.tables else self._views.get(key)

    def _schema(self, parts: list[str]):
        frame = self._frame(parts)
        return None if frame is None else frame.dtypes

    def table(self, name: str) -> DataFrame:
        frame = self._frame(name.split("."))
        if frame is None:
            raise er.TableNotFound(f"no table {name}")
        return frame

    # -- queries

    def _constants(self) -> dict[str, str]:
        from skarn.functions.scalar import quoted

        last = f"cast({self.last_insert_id} AS bigint)"
        database = {n: quoted(self.database) for n in ("database", "current_database")} | {n: quoted(self.settings.path()[0]) for n in ("schema", "current_schema")}
        return {"last_insert_id": last, "lastval": last, "row_count": f"cast({self.row_count} AS bigint)", "connection_id": f"cast({self.number} AS bigint)", **database} | {
            "@@" + k: str(int(v)) if isinstance(v, int) else quoted(v) for k, v in self.variables().items()
        }

    def variables(self) -> dict[str, Any]:
        """System variables by name."""
        return vars(self.settings) | {"collation": self.settings.active_collation(), "version": VERSION, "in_transaction": self._begun is not None, "last_insert_id": self.last_insert_id}

    def _relation(self, used: dict[str, DataFrame]):
        """What a rewriter calls a table: a view of this moment, noted in used."""

        def of(parts: list[str]) -> list[str]:
            frame = self._frame(parts)
            if frame is None:
                return parts if len(parts) == 1 else ["_no_table_", ".".join(parts)]
            view = f"_skarn{self.number}_" + re.sub(r"\W", lambda m: f"_{ord(m[0])}_", self._key(parts))
            used[view] = frame
            return [view]

        return of

    @contextmanager
    def _visible(self, used: dict[str, DataFrame]):
        """Tables as temporary views while a plan is analysed; the plan then holds the tables themselves."""
        for view, frame in used.items():
            frame.createOrReplaceTempView(view)
        try:
            yield
        finally:
            for view in used:
                self.spark.catalog.dropTempView(view)

    def _rewritten(self, sql: str, used: dict[str, DataFrame]) -> str:
        return Rewriter(sql, self._schema, self.settings.active_collation(), self._constants(), self._relation(used)).statement()

    def rewrite(self, sql: str) -> str:
        return self._rewritten(sql, {})

    def query(self, sql: str, params: tuple | list = ()) -> DataFrame:
        used: dict[str, DataFrame] = {}
        try:
            text = self._rewritten(sql, used) if re.match(r"[\s(]*(select|with)\b", sql, re.I) else sql
            raw = text is sql
        except Unsupported:
            text, raw = sql, True
        if raw:  # a form that only Spark knows: plain names
            used = {k.split(".")[-1]: self.table(k) for k in {*self._views, *self._state.tables} if self._key([k.split(".")[-1]]) == k}
        try:
            with self._visible(used):
                return self.spark.sql(text, args=list(params)) if params else self.spark.sql(text)
        except PySparkException as e:
            raise er.of_spark(e) from e

    def plan(self, sql: str) -> str:
        """Spark's plan of a query, formatted."""
        return self.query(sql)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def query_with_columns(self, sql: str, params: tuple | list = ()) -> tuple[list[str], list[tuple]]:
        frame = self.query(sql, params)
        return frame.columns, [tuple(r) for r in frame.collect()]

    def text_result(self, sql: str, params: tuple | list = ()) -> DataFrame:
        """A query's rows as texts, as a client of the text protocol gets them: truth values as 1 and 0, bytes in hexadecimal."""
        frame = self.query(sql, params)
        forms = {"boolean": lambda c: c.cast("int").cast("string"), "binary": F.hex}
        return frame.toDF(*(f"c{i}" for i in range(len(frame.columns)))).select(*(forms.get(t, lambda c: c.cast("string"))(F.col(f"c{i}")).alias(n) for i, (n, t) in enumerate(frame.dtypes)))

    def function(self, name: str, of: Callable, returns: str) -> Session:
        """Make a function of pandas series known to queries; Arrow batches, never row by row."""
        self.spark.udf.register(name, F.pandas_udf(of, returns))
        return self

    def table_function(self, name: str, of: type) -> Session:
        """Make a user-defined table function (a class under pyspark's @udtf) known to queries."""
        self.spark.udtf.register(name, of)
        return self

    def prepare(self, sql: str) -> Prepared:
        tokens(sql)
        return Prepared(self, sql)

    def run(self, script: str) -> list:
        return [self.execute(s) for s in split_statements(script)]

    def execute(self, sql: str, params: tuple | list = ()) -> Any:
        words = [t for t in tokens(sql) if t.kind != "end"]
        if not words:
            return None
        head = words[0].value.upper()
        action = getattr(self, f"_do_{head.lower()}", None)
        self.statements[head.lower()] += 1
        if not self.settings.autocommit and self._begun is None and head in ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "WITH"):
            self._begun, self._savepoints = self._state, {}
        if head in ("SELECT", "WITH", "VALUES", "("):
            return self.query(sql, params)
        if action is None:
            raise SyntaxFault(f"unknown statement {head}")
        before = self._state
        try:
            out = action(_Reader(self, sql, params))
            self.row_count = out.count if isinstance(out, Affected) else -1
            return out
        except (EngineError, PySparkException, NotImplementedError) as e:
            self._state = before
            mode = self.settings.on_error
            if mode == "rollback_transaction" and self._begun:
                self._state, self._begun, self._savepoints = self._begun, None, {}
            if mode == "ignore" and isinstance(e, er.ConstraintViolation):
                self.warnings.append(str(e))
                return Affected(0)
            if isinstance(e, EngineError):
                raise
            raise (er.of_spark(e) if isinstance(e, PySparkException) else er.NotSupported(str(e))) from e

    # -- state

    def _own(self, key: str) -> tb.Table:
        if key not in self._state.tables:
            raise er.TableNotFound(f"no table {key}")
        return self._state.tables[key]

    def _put(self, changed: dict[str, tb.Table]) -> None:
        self._state = replace(self._state, tables=changed)

    def _replace(self, name: str, table: tb.Table) -> None:
        self._put(self._state.tables | {name: table})

    def begin(self):
        return self.execute("BEGIN")

    def commit(self):
        return self.execute("COMMIT")

    def rollback(self):
        return self.execute("ROLLBACK")

    def _do_begin(self, r):
        if self._begun is not None:
            raise er.TransactionOpen("a transaction is open")
        self._begun, self._savepoints = self._state, {}

    _do_start = _do_begin

    def _do_commit(self, r):
        self._begun, self._savepoints = None, {}

    def _do_rollback(self, r):
        r.word("ROLLBACK")
        if r.word("TO"):
            r.word("SAVEPOINT")
            name = r.identifier()
            if name not in self._savepoints:
                raise NotFound(f"no savepoint {name}")
            self._state = self._savepoints[name]
        elif self._begun is not None:
            self._state, self._begun, self._savepoints = self._begun, None, {}

    def _do_savepoint(self, r):
        r.word("SAVEPOINT")
        self._savepoints[r.identifier()] = self._state

    def _do_release(self, r):
        r.word("RELEASE")
        r.word("SAVEPOINT")
        if self._savepoints.pop(r.identifier(), None) is None:
            raise NotFound("no such savepoint")

    def _do_vacuum(self, r):
        """VACUUM: delete the directories of versions that no table, transaction or savepoint refers to; a DataFrame
        that was made from one can't be read any more.
        """
        states = [self._state, self._begun, *self._savepoints.values()]
        return Affected(self._versions.vacuum({p for s in states if s for t in s.tables.values() for p in t.paths}))

    # -- DML

    def _do_insert(self, r):
        r.need("INSERT")
        r.need("INTO")
        name = r.table_name()
        table = self._own(name)
        names = [c.name for c in table.columns]
        if r.sign("("):
            names = r.listed(r.identifier)
            r.need(")")
            for n in names:
                table.column(n)
        if r.word("DEFAULT"):
            raise er.NotSupported("INSERT ... DEFAULT VALUES")
        if r.word("VALUES"):
            rows = r.listed(r.row)
            if any(len(row) != len(names) for row in rows):
                raise EngineError("the number of values differs from the number of columns")
            if any(re.search(r"\buuid\(|\bSELECT\b", e) for row in rows for e in row):  # no inline table has these
                text = " UNION ALL ".join(f"SELECT {', '.join(row)}" for row in rows)
            else:
                text = "VALUES " + ", ".join(f"({', '.join(row)})" for row in rows)
            with self._visible(r.views):
                source = self.spark.sql(text, args=list(r.params) or None)
        else:
            source = self.query(r.rest(), r.params)
            if len(source.columns) != len(names):
                raise EngineError("the number of values differs from the number of columns")
        if not self.settings.strict_mode:
            source = source.toDF(*names).select(*(self._lenient(source.dtypes[i][1], n, table.column(n).type) for i, n in enumerate(names)))
        path, first, following = self._versions.write(tb.in_columns(table, source, names)), None, table.next_id
        try:
            if auto := next((c.name for c in table.columns if c.auto_increment), None):
                path, following, first = tb.with_ids(table, auto, path, self._versions)
            fresh = self._versions.read(table.data.schema, path)
            count = fresh.count()
            tb.validate(table, name, self._state.tables, fresh)
        except Exception:
            self._versions.drop(path)
            raise
        self._replace(name, self._versions.appended(replace(table, next_id=following), path))
        self.last_insert_id = first or self.last_insert_id
        return Affected(count, first)

    def _lenient(self, given: str, name: str, wanted: str):
        """Permissive coercion of texts to numbers; the numeric prefix, or 0."""
        from skarn.functions.scalar import to_number_permissive

        if given == "string" and wanted in ("int", "bigint", "double"):
            self.warnings.append(f"{name} was coerced")
            return F.expr(to_number_permissive(f"`{name}`", "real" if wanted == "double" else "int")).cast(wanted).alias(name)
        return F.col(f"`{name}`")

    def _do_update(self, r):
        r.need("UPDATE")
        name = r.table_name()
        table = self._own(name)
        r.scope_of(name, table.data)
        r.need("SET")
        assigned = {}
        for _ in iter(lambda: True, False):
            column = r.identifier()
            table.column(column)
            r.need("=")
            assigned[column] = r.expression()[0]
            if not r.sign(","):
                break
        where = r._condition() if r.word("WHERE") else "TRUE"
        r.end()
        assigned = {c: r.bound(e) for c, e in assigned.items()}
        where = r.bound(where)
        with self._visible(r.views):
            rows = table.data.alias(r.alias(name))
            count = rows.filter(where).count()
            new = self._versions.rewritten(table, tb.updated(rows, {c: F.expr(e) for c, e in assigned.items()}, F.expr(where)))
        tb.validate(new, name, self._state.tables | {name: new})
        for child_name, child in self._state.tables.items():
            if any(k.parent == name and k.parent_column in assigned for k in child.foreign_keys):
                tb.validate(new if child_name == name else child, child_name, self._state.tables | {name: new})
        self._replace(name, new)
        return Affected(count)

    def _do_delete(self, r):
        r.need("DELETE")
        r.need("FROM")
        name = r.table_name()
        table = self._own(name)
        r.scope_of(name, table.data)
        where = r.bound(r._condition()) if r.word("WHERE") else "TRUE"
        r.end()
        with self._visible(r.views):
            rows = table.data.alias(r.alias(name))
            doomed = rows.filter(where)
            count = doomed.count()
            left = tb.remaining(rows, F.expr(where))
        if not count:
            return Affected(0)
        path = self._versions.write(left)  # before the cascade, which may change what the predicate reads
        changed = tb.deleted(self._state.tables, name, doomed, self._versions)
        if changed[name] is table:
            changed[name] = replace(table, data=self._versions.read(table.data.schema, path), paths=(path,))
        else:  # the cascade came back to this table
            with self._visible(r.views):
                changed[name] = self._versions.rewritten(changed[name], tb.remaining(changed[name].data.alias(r.alias(name)), F.expr(where)))
        self._put(changed)
        return Affected(count)

    def _do_truncate(self, r):
        r.need("TRUNCATE")
        r.word("TABLE")
        name = r.table_name()
        table = self._own(name)
        if any(k.parent == name for n, t in self._state.tables.items() if n != name for k in t.foreign_keys):
            raise er.ForeignKeyParentViolation(f"{name} is referred to by a foreign key")
        self._replace(name, replace(table, data=self._versions.read(table.data.schema), next_id=1, paths=()))
        return Affected(0)

    # -- DDL

    def _do_create(self, r):
        r.need("CREATE")
        if r.word("DATABASE"):
            missing = r.exists_clause("NOT")
            name = r.identifier()
            if name in self._state.databases() and not missing:
                raise er.DatabaseExists(f"database {name} exists")
            return self._add_schema(name, SCHEMA)
        if r.word("SCHEMA"):
            missing = r.exists_clause("NOT")
            name = r.identifier()
            if (self.database, name) in self._state.schemas and not missing:
                raise er.SchemaExists(f"schema {name} exists")
            return self._add_schema(self.database, name)
        unique = r.word("UNIQUE")
        if r.word("INDEX"):
            return self._create_index(r, unique)
        r.need("TABLE")
        missing = r.exists_clause("NOT")
        name = r.table_name(new=True)
        if name in self._state.tables:
            if missing:
                return None
            raise er.Exists(f"table {name} exists")
        r.need("(")
        columns, constraints, keys = [], [], []
        for _ in iter(lambda: True, False):
            if r.now.is_word("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT"):
                r.table_constraint(constraints, keys)
            else:
                columns.append(r.column_def(constraints, keys))
            if not r.sign(","):
                break
        r.need(")")
        r.end()
        primary = {c for k in constraints if k.kind == "primary key" for c in k.columns}
        columns = tuple(replace(c, nullable=c.nullable and c.name not in primary) for c in columns)
        if repeated := [n for n, k in Counter(c.name for c in columns).items() if k > 1]:
            raise er.ColumnExists(f"column {repeated[0]} is there twice")
        made = tb.Table(columns, self._versions.read(tb.schema_of(columns)), tuple(constraints), tuple(keys))
        self._check_keys(made, name)
        self._replace(name, made)
        return None

    def _add_schema(self, database: str, schema: str) -> None:
        self._state = replace(self._state, schemas=tuple(dict.fromkeys((*self._state.schemas, (database, schema)))))

    def _check_keys(self, table: tb.Table, name: str) -> None:
        """Every foreign key refers to a unique column of a table that is there, and comes from columns of its own."""
        for key in table.foreign_keys:
            parent = table if key.parent == name else self._own(key.parent)
            table.column(key.column), parent.column(key.parent_column)
            if not parent.is_key(key.parent_column):
                raise er.NoParentKey(f"{key.parent}.{key.parent_column} is no primary key and not unique")
        for c in table.constraints:
            for n in c.columns:
                table.column(n)

    def _create_index(self, r, unique: bool):
        """Indexes are advisory: Parquet statistics serve lookups. A unique index is a constraint, partial if it has WHERE."""
        missing = r.exists_clause("NOT")
        index = r.identifier()
        r.need("ON")
        name = r.table_name()
        table = self._own(name)
        if index in table.indexes:
            if missing:
                return None
            raise er.Exists(f"index {index} exists")
        if r.word("USING"):
            r.identifier()
        r.need("(")
        columns = r.listed(r.index_column)
        r.need(")")
        for n in columns:
            table.column(n)
        if r.word("USING"):
            r.identifier()
        if r.word("INCLUDE"):
            r.need("(")
            for n in r.listed(r.identifier):
                table.column(n)
            r.need(")")
        r.scope_of(name, table.data)
        where = r.expression()[0] if r.word("WHERE") else None
        if r.word("WITH"):
            r.need("(")
            r.listed(lambda: (r.identifier(), r.need("="), r.take()))
            r.need(")")
        r.end()
        new = replace(table, indexes=table.indexes | {index: ",".join(columns)})
        if unique:
            new = replace(new, constraints=(*new.constraints, tb.Constraint("unique", tuple(columns), name=index, where=where)))
            tb.validate(new, name, self._state.tables)
        self._replace(name, new)
        return None

    def _do_drop(self, r):
        r.need("DROP")
        if r.word("DATABASE"):
            there = r.exists_clause()
            name = r.identifier()
            if name not in self._state.databases():
                if there:
                    return None
                raise er.DatabaseNotFound(f"no database {name}")
            if name in (self.database, DATABASE):
                raise er.ActiveDatabaseDrop(f"database {name} is in use")
            return self._drop_schemas([s for s in self._state.schemas if s[0] == name])
        if r.word("SCHEMA"):
            there = r.exists_clause()
            name = r.identifier()
            if (self.database, name) not in self._state.schemas:
                if there:
                    return None
                raise er.SchemaNotFound(f"no schema {name}")
            if name == SCHEMA:
                raise er.ActiveDatabaseDrop(f"schema {name} is in use")
            return self._drop_schemas([(self.database, name)])
        if r.word("INDEX"):
            there = r.exists_clause()
            index = r.identifier()
            r.need("ON")
            name = r.table_name()
            table = self._own(name)
            if index not in table.indexes and not there:
                raise NotFound(f"no index {index}")
            self._replace(name, replace(table, indexes={k: v for k, v in table.indexes.items() if k != index}, constraints=tuple(c for c in table.constraints if c.name != index)))
            return None
        r.need("TABLE")
        there = r.exists_clause()
        names = r.listed(r.table_name)
        cascade = r.word("CASCADE")
        r.word("RESTRICT")
        r.end()
        for name in names:
            if name not in self._state.tables and not there:
                raise er.TableNotFound(f"no table {name}")
        self._drop_tables(names, cascade)
        return None

    def _drop_tables(self, names: list[str], cascade: bool) -> None:
        """cascade: foreign keys of other tables to these go with them."""
        left = {k: t for k, t in self._state.tables.items() if k not in names}
        for k, t in left.items():
            if needed := [key for key in t.foreign_keys if key.parent in names]:
                if not cascade:
                    raise er.DependentObjects(f"{k} refers to {needed[0].parent}")
                left[k] = replace(t, foreign_keys=tuple(key for key in t.foreign_keys if key.parent not in names))
        self._put(left)

    def _drop_schemas(self, gone: list[tuple[str, str]]) -> None:
        self._drop_tables([k for k in self._state.tables if tuple(k.split(".")[:2]) in gone], cascade=True)
        self._state = replace(self._state, schemas=tuple(s for s in self._state.schemas if s not in gone))

    def _do_alter(self, r):
        r.need("ALTER")
        r.need("TABLE")
        name = r.table_name()
        t = self._own(name)
        if r.word("ADD"):
            constraints, keys = list(t.constraints), list(t.foreign_keys)
            if r.now.is_word("CONSTRAINT", "UNIQUE", "FOREIGN", "CHECK", "PRIMARY"):
                r.scope_of(name, t.data)
                r.table_constraint(constraints, keys)
            else:
                r.word("COLUMN")
                c = r.column_def(constraints, keys)
                if any(o.name == c.name for o in t.columns):
                    raise er.ColumnExists(f"column {c.name} exists")
                t = self._versions.rewritten(replace(t, columns=(*t.columns, c)), t.data.withColumn(c.name, F.expr(c.default or "NULL").cast(c.type)))
            t = replace(t, constraints=tuple(constraints), foreign_keys=tuple(keys))
            self._check_keys(t, name)
            tb.validate(t, name, self._state.tables | {name: t})
        elif r.word("DROP"):
            if r.word("CONSTRAINT"):
                there = r.exists_clause()
                gone = r.identifier()
                if not there and gone not in [c.name for c in (*t.constraints, *t.foreign_keys)]:
                    raise NotFound(f"no constraint {gone}")
                t = replace(t, constraints=tuple(c for c in t.constraints if c.name != gone), foreign_keys=tuple(k for k in t.foreign_keys if k.name != gone))
            else:
                r.word("COLUMN")
                there = r.exists_clause()
                gone = r.identifier()
                if there and gone not in t.data.columns:
                    return None
                t.column(gone)
                inside = re.compile(re.escape(f"`{gone}`"))
                uses = [c for c in t.constraints if gone in c.columns or inside.search(c.expression + (c.where or ""))] + [k for k in t.foreign_keys if k.column == gone]
                uses += [k for o in self._state.tables.values() for k in o.foreign_keys if (k.parent, k.parent_column) == (name, gone)]
                if uses or len(t.columns) == 1:
                    raise er.DependentObjects(f"column {gone} is needed")
                indexes = {i: c for i, c in t.indexes.items() if gone not in c.split(",")}
                t = self._versions.rewritten(replace(t, columns=tuple(c for c in t.columns if c.name != gone), indexes=indexes), t.data.drop(gone))
        elif r.word("RENAME"):
            if r.word("TO"):
                parts = r.name_parts()
                new = self._key(parts, new=True) if len(parts) > 1 else f"{name.rpartition('.')[0]}.{parts[0]}"
                if new in self._state.tables and new != name:
                    raise er.Exists(f"table {new} exists")
                swapped = lambda n: new if n == name else n
                self._put({swapped(k): replace(v, foreign_keys=tuple(replace(f, parent=swapped(f.parent)) for f in v.foreign_keys)) for k, v in self._state.tables.items()})
                return None
            r.word("COLUMN")
            old = r.identifier()
            r.need("TO")
            new = r.identifier()
            t.column(old)
            if new in t.data.columns and new != old:
                raise er.ColumnExists(f"column {new} exists")
            swap = lambda n: new if n == old else n
            text = lambda e: e and re.sub(r"'(?:[^'\\\\]|\\\\.)*'|" + re.escape(f"`{old}`"), lambda m: m[0] if m[0][0] == "'" else f"`{new}`", e)
            t = self._versions.rewritten(
                replace(
                    t, columns=tuple(replace(c, name=swap(c.name)) for c in t.columns), indexes={i: ",".join(map(swap, c.split(","))) for i, c in t.indexes.items()},
                    constraints=tuple(replace(c, columns=tuple(map(swap, c.columns)), expression=text(c.expression), where=text(c.where)) for c in t.constraints),
                    foreign_keys=tuple(replace(k, column=swap(k.column), parent_column=swap(k.parent_column) if k.parent == name else k.parent_column) for k in t.foreign_keys),
                ), t.data.withColumnRenamed(old, new),
            )
            others = {k: replace(o, foreign_keys=tuple(replace(f, parent_column=swap(f.parent_column)) if f.parent == name else f for f in o.foreign_keys)) for k, o in self._state.tables.items() if k != name}
            self._put(self._state.tables | others)
        elif r.word("REBUILD"):
            t = self._versions.rewritten(t, t.data)
        else:
            raise er.NotSupported(f"ALTER TABLE ... {r.now.value}")
        self._replace(name, t)
        return None

    # -- session and utility statements

    def _do_set(self, r):
        r.need("SET")
        r.word("SESSION")
        name = r.take().value.lower()
        while r.sign("."):
            name = r.take().value.lower()
        name = "compat" if name.endswith("_compat") else name
        if name == "transaction":
            name = "transaction_isolation"
            r.word("ISOLATION")
            r.word("LEVEL")
        r.sign("=") or r.word("TO")
        value = " ".join(t.value for t in r.tokens[r.at : -1] if t.value != ";").strip().lower()
        if name not in Settings.__dataclass_fields__:
            raise er.InvalidValue(f"unknown setting {name}")
        default = Settings.__dataclass_fields__[name].default
        value = str(default).lower() if value == "default" else value
        if name == "search_path":
            if not Settings(search_path=value).path():
                raise er.InvalidValue("an empty search path")
            value = ", ".join(Settings(search_path=value).path())
        if name == "sql_mode":
            value = ",".join(m.strip().upper() for m in value.split(",") if m.strip())
            self.settings.strict_mode = any(m in _STRICT for m in value.split(","))
        if name == "transaction_isolation":
            value = {"read uncommitted": "read committed"}.get(value.replace("-", " "), value.replace("-", " "))
        if name in _CHOICES and value not in _CHOICES[name]:
            raise er.InvalidValue(f"{name} can't be {value}")
        if isinstance(default, bool) and value not in ("0", "1", "on", "off", "true", "false") or default is not True and isinstance(default, int) and not value.isdigit():
            raise er.InvalidValue(f"{name} can't be {value}")
        typed = value in ("1", "on", "true") if isinstance(default, bool) else int(value) if isinstance(default, int) else value
        if name == "autocommit" and typed:
            self._begun, self._savepoints = None, {}
        setattr(self.settings, name, typed)

    def _do_use(self, r):
        r.need("USE")
        name = r.identifier()
        if name not in self._state.databases():
            raise er.DatabaseNotFound(f"no database {name}")
        self.database, self.settings.search_path = name, SCHEMA

    def _do_show(self, r):
        r.need("SHOW")
        if r.word("TABLES"):
            where = f"{self.database}.{r.identifier() if r.word('FROM') else self.settings.path()[0]}."
            names = sorted(k[len(where) :] for k in {*self._views, *self._state.tables} if k.startswith(where))
            return self.spark.createDataFrame([(n,) for n in names], "table_name string")
        if r.word("DATABASES"):
            return self.spark.createDataFrame([(d,) for d in self._state.databases()], "database_name string")
        if r.word("SCHEMAS"):
            return self.spark.createDataFrame([(s,) for d, s in sorted(self._state.schemas) if d == self.database], "schema_name string")
        if r.word("COLUMNS"):
            r.need("FROM")
            return self._describe(r.table_name())
        if r.word("WARNINGS"):
            return self.spark.createDataFrame([("Warning", 0, w) for w in self.warnings], "level string, code int, message string")
        if r.word("VARIABLES"):
            like = re.sub("[%_]", lambda m: ".*" if m[0] == "%" else ".", r.take().value.lower()) if r.word("LIKE") else ".*"
            shown = {k: ("ON" if v else "OFF") if isinstance(v, bool) else str(v) for k, v in self.variables().items()}
            return self.spark.createDataFrame([(k, v) for k, v in sorted(shown.items()) if re.fullmatch(like, k)], "variable_name string, value string")
        if r.word("STATUS"):
            tracker = self.spark.sparkContext.statusTracker()
            counts = {"uptime": int(time.time() * 1000 - self.spark.sparkContext.startTime) // 1000, "questions": sum(self.statements.values()), "threads_running": len(tracker.getActiveJobsIds()), "open_tables": len(self._state.tables) + len(self._views)}
            counts |= {f"com_{k}": n for k, n in self.statements.items()}
            return self.spark.createDataFrame([(k, str(v)) for k, v in sorted(counts.items())], "variable_name string, value string")
        if r.word("PROCESSLIST"):
            row = (self.number, self.spark.sparkContext.sparkUser(), self.spark.conf.get("spark.driver.host", "localhost"), self.database, "Query", 0, "executing", "SHOW PROCESSLIST")
            return self.spark.createDataFrame([row], "Id long, User string, Host string, db string, Command string, Time long, State string, Info string")
        raise EngineError(f"can't show {r.now.value}")

    def _describe(self, name: str) -> DataFrame:
        if name not in self._state.tables and name not in self._views:
            raise er.TableNotFound(f"no table {name}")
        if name in self._state.tables:
            t = self._state.tables[name]
            primary = {c for k in t.constraints if k.kind == "primary key" for c in k.columns}
            rows = [(c.name, c.type, "YES" if c.nullable else "NO", "PRI" if c.name in primary else "", c.default, "auto_increment" if c.auto_increment else "") for c in t.columns]
        else:
            rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", "", None, "") for f in self._views[name].schema.fields]
        return self.spark.createDataFrame(rows, "field string, type string, `null` string, `key` string, `default` string, extra string")

    def _do_describe(self, r):
        r.take()
        return self._describe(r.table_name())

    _do_desc = _do_describe

    def _do_explain(self, r):
        """A row as MySQL has it, and Spark's plan beside it: of a query, how its first table is reached."""
        r.need("EXPLAIN")
        text, plan = r.rest(), None
        kind = r.now.value.upper()
        row: list = [1, kind if kind in ("INSERT", "UPDATE", "DELETE") else "OTHER", "-", *[None] * 7]
        if kind in ("SELECT", "WITH"):
            plan = self.query(text, r.params)
            words = [t for t in tokens(text) if t.kind != "end"]
            at = next((i for i, t in enumerate(words) if t.is_word("FROM")), None)
            row[1:3] = "SIMPLE", None
            if at is not None and words[at + 1].kind in ("word", "name"):
                parts = [words[at + 1].value]
                while at + 3 < len(words) and words[at + 2].value == ".":
                    parts, at = [*parts, words[at + 3].value], at + 2
                if (frame := self._frame(parts)) is not None:
                    row[1:] = self._access(self._key(parts), parts[-1], frame, words[at + 2 :])
            plan = plan._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        columns = "id int, select_type string, `table` string, type string, possible_keys string, `key` string, key_len int, ref string, `rows` long, Extra string, plan string"
        return self.spark.createDataFrame([(*row, plan)], columns)

    def _access(self, key: str, name: str, frame: DataFrame, words: list) -> list:
        """select_type to Extra: by the declared keys and indexes whose first column the WHERE clause compares."""
        where = next((i for i, t in enumerate(words) if t.is_word("WHERE")), None)
        tests: dict[str, str] = {}
        for a, b in zip(words[where:], words[where + 1 :], strict=False) if where is not None else ():
            if a.kind in ("word", "name") and (b.value in ("=", "<", ">", "<=", ">=") or b.is_word("BETWEEN", "IN")):
                tests.setdefault(a.value, "=" if b.value == "=" else "range")
        t = self._state.tables.get(key)
        keys = [("PRIMARY" if c.kind == "primary key" else c.name or ",".join(c.columns), c.columns, True) for c in t.constraints if c.columns] + [(i, tuple(c.split(",")), False) for i, c in t.indexes.items()] if t else []
        usable = [k for k in dict((k[0], k) for k in reversed(keys)).values() if k[1][0] in tests]
        out = ["SIMPLE", name, "ALL", None, None, None, None, frame.count(), "Using where" if where is not None else ""]
        if usable:
            best = min(usable, key=lambda k: (tests[k[1][0]] != "=", not k[2]))
            exact = tests[best[1][0]] == "="
            out[2:7] = ("const" if best[2] and len(best[1]) == 1 else "ref") if exact else "range", ",".join(sorted(k[0] for k in usable)), best[0], None, "const" if exact else None
            out[8] = "Using where" if exact else "Using where; Using index condition"
        return out

    def _do_analyze(self, r):
        r.need("ANALYZE")
        if not r.word("TABLE"):
            parts = [(n.removeprefix(f"{DATABASE}.{SCHEMA}."), t.data) for n, t in sorted(self._state.tables.items())]
        else:
            name = r.table_name()
            if name not in self._state.tables and name not in self._views:
                raise er.TableNotFound(f"no table {name}")
            columns = None
            if r.sign("("):
                columns = r.listed(r.identifier)
                r.need(")")
            return tb.column_statistics(self._state.tables[name].data if name in self._state.tables else self._views[name], columns)
        out = None
        for name, data in parts:
            stats = tb.column_statistics(data).select(F.lit(name).alias("table_name"), "*")
            out = stats if out is None else out.unionByName(stats)
        return out


class _Reader(Rewriter):
    """Grammar of the statements that are no SELECT."""

    def __init__(self, session: Session, sql: str, params):
        self.views: dict[str, DataFrame] = {}
        super().__init__(sql, session._schema, session.settings.active_collation(), session._constants(), session._relation(self.views))
        self.session, self.sql, self.params, self.used = session, sql, tuple(params), 0

    listed: Callable = Rewriter._list

    def name_parts(self) -> list[str]:
        parts = [self.identifier()]
        while self.sign("."):
            parts.append(self.identifier())
        return parts

    def table_name(self, new: bool = False) -> str:
        return self.session._key(self.name_parts(), new)

    @staticmethod
    def alias(name: str) -> str:
        return name.split(".")[-1]

    def rest(self) -> str:
        return self.sql[self.now.place :]

    def scope_of(self, name: str, data: DataFrame) -> None:
        self._known(self.alias(name), [(n, t) for n, t in self._tags(data)])

    @staticmethod
    def _tags(data: DataFrame):
        from skarn.plans.dialect import tag_of

        return [(n, tag_of(t)) for n, t in data.dtypes]

    def row(self) -> list[str]:
        self.need("(")
        out = [e[0] for e in self.listed(self.expression)]
        self.need(")")
        return out

    def bound(self, sql: str) -> str:
        """Put the parameters into an expression, in order."""
        def value(_):
            self.used += 1
            return _literal(self.params[self.used - 1])

        return re.sub(r"'(?:[^'\\]|\\.)*'|`[^`]*`|\?", lambda m: m[0] if m[0] != "?" else value(m), sql)

    def exists_clause(self, *before: str) -> bool:
        if not self.word("IF"):
            return False
        for w in before:
            self.need(w)
        self.need("EXISTS")
        return True

    def index_column(self) -> str:
        name = self.identifier()
        self.word("ASC") or self.word("DESC")
        return name

    def _names(self) -> tuple[str, ...]:
        self.need("(")
        out = tuple(self.listed(self.index_column))
        self.need(")")
        return out

    def _check(self, known=()) -> str:
        self.need("(")
        out = self.expression()[0]
        self.need(")")
        return out

    def _reference(self, column: str, name: str | None) -> tb.ForeignKey:
        parent = self.table_name()
        target = self._names()
        if len(target) != 1:
            raise er.NotSupported("composite foreign keys")
        action = "NO ACTION"
        while self.word("ON"):
            kind = self.take().value.upper()
            words = self.take().value.upper()
            if words in ("SET", "NO"):
                words += " " + self.take().value.upper()
            if words == "SET DEFAULT":
                raise er.NotSupported("SET DEFAULT")
            if kind == "DELETE":
                action = words
            elif words not in ("NO ACTION", "RESTRICT"):
                raise er.NotSupported(f"ON UPDATE {words}")
        return tb.ForeignKey(column, parent, target[0], action, name)

    def column_def(self, constraints: list, keys: list) -> tb.ColumnDef:
        name = self.identifier()
        serial = self.now.is_word("SERIAL")
        kind = self.type_name()[0]
        out = tb.ColumnDef(name, kind, auto_increment=serial)
        while True:
            if self.word("NOT"):
                self.need("NULL")
                out = replace(out, nullable=False)
            elif self.word("NULL"):
                pass
            elif self.word("DEFAULT"):
                out = replace(out, default=self._sum()[0])
            elif self.word("UNIQUE"):
                constraints.append(tb.Constraint("unique", (name,)))
            elif self.word("PRIMARY"):
                self.need("KEY")
                constraints.append(tb.Constraint("primary key", (name,)))
            elif self.word("AUTO_INCREMENT"):
                out = replace(out, auto_increment=True)
            elif self.word("REFERENCES"):
                keys.append(self._reference(name, None))
            elif self.word("CHECK"):
                constraints.append(tb.Constraint("check", expression=self._check()))
            else:
                return out

    def table_constraint(self, constraints: list, keys: list) -> None:
        name = self.identifier() if self.word("CONSTRAINT") else None
        if self.word("PRIMARY"):
            self.need("KEY")
            constraints.append(tb.Constraint("primary key", self._names(), name=name))
        elif self.word("UNIQUE"):
            constraints.append(tb.Constraint("unique", self._names(), name=name))
        elif self.word("CHECK"):
            constraints.append(tb.Constraint("check", expression=self._check(), name=name))
        else:
            self.need("FOREIGN")
            self.need("KEY")
            columns = self._names()
            if len(columns) != 1:
                raise er.NotSupported("composite foreign keys")
            self.need("REFERENCES")
            keys.append(self._reference(columns[0], name))


def _literal(value: Any) -> str:
    from skarn.functions.scalar import quoted

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return quoted(value) if isinstance(value, str) else f"{value!r}D" if isinstance(value, float) else str(value)
