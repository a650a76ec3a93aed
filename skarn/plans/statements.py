"""Queries of the catalogue for statements: DML with subqueries, DDL, constraints, namespaces, transactions, settings, errors."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from skarn import errors as er
from skarn.plans.catalogue import dialect
from skarn.plans.registry import register
from skarn.session import Session


def _after(script: str, query: str, attach: tuple[str, ...] = ()):
    """Run a script in a new session, then a query."""

    def run(spark, sf_dir):
        s = Session(spark).attach(sf_dir, attach)
        s.run(script)
        return s.query(query)

    return run


def _refused(session: Session, statement: str) -> tuple[str, int]:
    """SQLSTATE and number of the error that a statement or a query's execution ends with."""
    try:
        result = session.execute(statement)
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
    except er.EngineError as e:
        return e.sqlstate, e.number
    except (PySparkException, Py4JJavaError) as e:
        found = er.of_spark(e)
        return found.sqlstate, found.number
    return "00000", 0


def _refusal(script: str, bad: str, table: str, attach: tuple[str, ...] = ()):
    """sqlstate and number of a refused statement, and the rows n that its table still has."""

    def run(spark, sf_dir):
        s = Session(spark).attach(sf_dir, attach)
        s.run(script)
        state, number = _refused(s, bad)
        return s.query(f"SELECT '{state}' AS sqlstate, {number} AS number, count(*) AS n FROM {table}")

    return run


_CUSTOMERS = "CREATE TABLE t (k BIGINT {}, s TEXT, b DOUBLE{}); INSERT INTO t SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
_FAMILY = "CREATE TABLE r (rk INT PRIMARY KEY, name TEXT UNIQUE); INSERT INTO r SELECT r_regionkey, r_name FROM region; CREATE TABLE n (nk INT PRIMARY KEY, rk INT REFERENCES r(rk){}); INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation"
_BOTH = ("region", "nation")


def _refuse(name: str, script: str, bad: str, table: str, attach: tuple[str, ...], state: str, number: int, source: str) -> None:
    register(name, _refusal(script, bad, table, attach), f"SELECT '{state}' AS sqlstate, {number} AS number, count(*) AS n FROM {source}")


# -- beyond the dialect, with its rules

dialect("cte_int_div", "WITH h AS (SELECT c_custkey, c_nationkey / 7 AS q FROM customer) SELECT q, count(*) AS n FROM h GROUP BY q", "SELECT CAST(c_nationkey // 7 AS BIGINT) AS q, count(*) AS n FROM customer GROUP BY 1")
dialect("cte_concat_null", "WITH c AS (SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT k, concat('q', q, '!') AS s FROM c", "SELECT d.doc_id AS k, concat('q', l.quality, '!') AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
dialect("cte_recursive", "WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 20) SELECT i, i / 3 AS q FROM s", "SELECT CAST(i AS INT) AS i, CAST(i // 3 AS BIGINT) AS q FROM range(1, 21) t(i)")
dialect("union_null_order", "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT -1, 7 / 2 ORDER BY q, k", "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT -1, 3")
dialect("window_null_order", "SELECT d.doc_id AS k, row_number() OVER (PARTITION BY d.lang ORDER BY l.quality, d.doc_id) AS up, row_number() OVER (PARTITION BY d.lang ORDER BY l.quality DESC, d.doc_id) AS down FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id AS k, CAST(row_number() OVER (PARTITION BY d.lang ORDER BY l.quality ASC NULLS LAST, d.doc_id) AS INT) AS up, CAST(row_number() OVER (PARTITION BY d.lang ORDER BY l.quality DESC NULLS FIRST, d.doc_id) AS INT) AS down FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
dialect("window_frame_sql", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
dialect("comma_join", "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_nationkey / 2 = 3", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey // 2 = 3")
dialect("grouping_sets", "SELECT p_brand, p_size / 10 AS d, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size / 10), ())", "SELECT p_brand, CAST(p_size // 10 AS BIGINT) AS d, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (d), ())")
dialect("agg_filter", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey / 5 = 1) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey // 5 = 1) AS n FROM customer GROUP BY c_mktsegment")
dialect("anti_not_in_nullable", "SELECT d.doc_id AS k FROM documents d WHERE d.doc_id NOT IN (SELECT l.doc_id FROM labels l WHERE l.toxic = 1)")
dialect("anti_not_in_expression", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey + 1 NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) OR n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region)", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey + 1 NOT IN (3, 4)")
dialect("decimal_arith", "SELECT c_custkey, CAST(CAST(c_custkey AS DECIMAL(10, 2)) + CAST('0.25' AS DECIMAL(4, 2)) AS TEXT) AS a, CAST(CAST(c_nationkey AS DECIMAL(6, 2)) * CAST('1.5' AS DECIMAL(3, 1)) AS TEXT) AS m, CAST(CAST(c_custkey AS DECIMAL(10, 2)) - 1 AS TEXT) AS s, CAST(CAST(c_custkey AS DECIMAL(10, 2)) % 7 AS TEXT) AS r, CAST(-CAST(c_nationkey AS DECIMAL(6, 1)) AS TEXT) AS n, round(CAST(CAST(c_custkey AS DECIMAL(10, 2)) / CAST('4' AS DECIMAL(2, 0)) AS DOUBLE), 4) AS q FROM customer", "SELECT c_custkey, CAST(CAST(c_custkey AS DECIMAL(10, 2)) + 0.25 AS VARCHAR) AS a, CAST(CAST(c_nationkey AS DECIMAL(6, 2)) * CAST('1.5' AS DECIMAL(3, 1)) AS VARCHAR) AS m, CAST(CAST(c_custkey - 1 AS DECIMAL(12, 2)) AS VARCHAR) AS s, CAST(CAST(c_custkey % 7 AS DECIMAL(12, 2)) AS VARCHAR) AS r, CAST(-CAST(c_nationkey AS DECIMAL(6, 1)) AS VARCHAR) AS n, c_custkey / 4 AS q FROM customer")
dialect("group_concat_two_keys", "SELECT n_regionkey, GROUP_CONCAT(DISTINCT substr(n_name, 1, 1) ORDER BY length(n_name) DESC, n_name SEPARATOR '-') AS g FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(c, '-' ORDER BY p) AS g FROM (SELECT n_regionkey, c, min(p) AS p FROM (SELECT n_regionkey, n_name[1] AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, n_name) AS p FROM nation) GROUP BY ALL) GROUP BY n_regionkey")
dialect("group_concat_empty_text", "SELECT r_regionkey, GROUP_CONCAT(DISTINCT substr(r_name, 1, 0) ORDER BY r_regionkey, r_name) AS e, GROUP_CONCAT(nullif(r_name, r_name)) AS n FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '' AS e, CAST(NULL AS VARCHAR) AS n FROM region")
dialect("group_concat_bound", "SELECT r_regionkey, length(GROUP_CONCAT(repeat(r_name, 300000))) AS n FROM region GROUP BY r_regionkey", "SELECT r_regionkey, 1048576 AS n FROM region")
dialect("filter_collation_wide", "SELECT n_nationkey FROM nation WHERE concat(n_name, 'Ế', 'Ά', 'Й') = concat(lower(n_name), 'e', 'α', 'и')", "SELECT n_nationkey FROM nation", collation="es")

# -- subqueries everywhere

dialect("subquery_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 200 FROM nation) + 9", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 9")
dialect("subquery_order_by", "SELECT n_nationkey FROM nation ORDER BY n_nationkey * (SELECT min(r_regionkey) - 1 FROM region)", "SELECT n_nationkey FROM nation")
dialect("subquery_in_join", "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = (SELECT max(r_regionkey) FROM region) AND c.c_custkey IN (SELECT o_custkey FROM orders)")
register("delete_in_subquery", _after("CREATE TABLE p (a BIGINT); CREATE TABLE q (a BIGINT); INSERT INTO p SELECT c_custkey FROM customer; INSERT INTO q VALUES (1); SELECT * FROM q; INSERT INTO q SELECT c_custkey FROM customer WHERE c_acctbal < 0; DELETE FROM p WHERE a IN (SELECT a FROM q)", "SELECT a FROM p", ("customer",)), "SELECT c_custkey AS a FROM customer WHERE c_acctbal >= 0 AND c_custkey <> 1")
register("delete_exists_correlated", _after("CREATE TABLE p (a BIGINT, s TEXT); INSERT INTO p SELECT c_custkey, c_mktsegment FROM customer; DELETE FROM p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.a)", "SELECT * FROM p", ("customer", "orders")), "SELECT c_custkey AS a, c_mktsegment AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
register("update_subquery", _after("CREATE TABLE p (a BIGINT, b DOUBLE); INSERT INTO p SELECT c_custkey, c_acctbal FROM customer; UPDATE p SET b = (SELECT max(r_regionkey) FROM region) WHERE a NOT IN (SELECT o_custkey FROM orders)", "SELECT * FROM p", ("customer", "orders", "region")), "SELECT c_custkey AS a, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN c_acctbal ELSE 4 END AS b FROM customer")
register("insert_subquery_values", _after("CREATE TABLE p (a BIGINT, u TEXT); INSERT INTO p VALUES ((SELECT count(*) FROM customer), gen_random_uuid()), (2, NULL)", "SELECT a, is_valid_uuid(u) AS v FROM p", ("customer",)), "SELECT count(*) AS a, true AS v FROM customer UNION ALL SELECT 2, NULL")

# -- DDL

register("alter_add_check", _refusal("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2); ALTER TABLE t ADD COLUMN b INT DEFAULT 5 CHECK (b < 10)", "INSERT INTO t VALUES (3, 50)", "t"), "SELECT '23514' AS sqlstate, 3819 AS number, 2 AS n")
register("alter_drop_column_if_exists", _after("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2); ALTER TABLE t DROP COLUMN IF EXISTS nothing; ALTER TABLE t DROP COLUMN IF EXISTS b", "SELECT * FROM t"), "SELECT 1 AS a")
register("alter_rename_checked_column", _refusal("CREATE TABLE t (a INT CHECK (a > 0)); INSERT INTO t VALUES (1); ALTER TABLE t RENAME COLUMN a TO z; INSERT INTO t (z) VALUES (2)", "INSERT INTO t VALUES (-1)", "t"), "SELECT '23514' AS sqlstate, 3819 AS number, 2 AS n")
register("rename_parent", _after(_FAMILY.format(" ON DELETE CASCADE") + "; ALTER TABLE r RENAME TO parts; ALTER TABLE parts RENAME COLUMN rk TO id; INSERT INTO n VALUES (90, 1); DELETE FROM parts WHERE id = 0", "SELECT nk, rk FROM n", _BOTH), "SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 90, 1")
_refuse("rename_to_existing", "CREATE TABLE a (x INT); INSERT INTO a VALUES (1); CREATE TABLE b (x INT); INSERT INTO b VALUES (1), (2)", "ALTER TABLE a RENAME TO b", "b", (), "42P07", 1050, "range(2)")
register("drop_then_create", _after("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); DROP TABLE t; CREATE TABLE t (b TEXT); INSERT INTO t VALUES ('x')", "SELECT * FROM t"), "SELECT 'x' AS b")
_refuse("drop_then_select", "CREATE TABLE t (a INT); INSERT INTO t VALUES (1); CREATE TABLE u (a INT); INSERT INTO u VALUES (4); DROP TABLE t", "SELECT * FROM t", "u", (), "42P01", 1146, "range(1)")
_refuse("drop_parent_refused", _FAMILY.format(""), "DROP TABLE r", "r", _BOTH, "2BP01", 3730, "region")
register("drop_cascade", _after(_FAMILY.format("") + "; DROP TABLE r CASCADE; INSERT INTO n VALUES (90, 77)", "SELECT nk, rk FROM n", _BOTH), "SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation UNION ALL SELECT 90, 77")
_refuse("fk_needs_key", _FAMILY.format("") + "; CREATE TABLE plain (a INT)", "CREATE TABLE c (a INT REFERENCES plain(a))", "n", _BOTH, "42830", 1822, "nation")
_refuse("index_unique_partial", _CUSTOMERS.format("", "") + "; CREATE UNIQUE INDEX one ON t (s) WHERE k < 0; INSERT INTO t VALUES (-1, 'x', 0.0), (1000000, 'x', 0.0)", "INSERT INTO t VALUES (-2, 'x', 0.0)", "t", ("customer",), "23505", 1062, "(SELECT 1 FROM customer UNION ALL SELECT 1 FROM range(2))")
register("index_brin_and_drop", _after("CREATE TABLE t (a INT, b INT); CREATE INDEX z ON t USING brin (a) WITH (pages_per_range = 4); CREATE UNIQUE INDEX u ON t (b DESC) INCLUDE (a); DROP INDEX u ON t; INSERT INTO t VALUES (1, 7), (2, 7)", "SELECT a, b FROM t WHERE a BETWEEN 1 AND 5"), "SELECT * FROM (VALUES (1, 7), (2, 7)) t(a, b)")

# -- constraints, by statements that break them

_refuse("insert_not_null_refused", _CUSTOMERS.format("NOT NULL", ""), "INSERT INTO t VALUES (NULL, 'x', 1.0)", "t", ("customer",), "23502", 1048, "customer")
_refuse("insert_key_refused", _CUSTOMERS.format("PRIMARY KEY", ""), "INSERT INTO t SELECT max(k), 'x', 0.0 FROM t", "t", ("customer",), "23505", 1062, "customer")
_refuse("insert_key_twice_refused", _CUSTOMERS.format("UNIQUE", ""), "INSERT INTO t VALUES (-5, 'x', 0.0), (-5, 'y', 0.0)", "t", ("customer",), "23505", 1062, "customer")
_refuse("insert_check_refused", _CUSTOMERS.format("", ", CHECK (b > -1000000)"), "INSERT INTO t VALUES (1, 'x', -2000000.0)", "t", ("customer",), "23514", 3819, "customer")
_refuse("insert_check_null_refused", _CUSTOMERS.format("", ", CONSTRAINT some CHECK (b > -1000000)"), "INSERT INTO t VALUES (1, 'x', NULL)", "t", ("customer",), "23514", 3819, "customer")
_refuse("insert_fk_refused", _FAMILY.format(""), "INSERT INTO n VALUES (99, 77)", "n", _BOTH, "23503", 1452, "nation")
_refuse("update_key_refused", _CUSTOMERS.format("PRIMARY KEY", ""), "UPDATE t SET k = 7", "t", ("customer",), "23505", 1062, "customer")
_refuse("update_parent_refused", _FAMILY.format(""), "UPDATE r SET rk = rk + 100", "r", _BOTH, "23503", 1452, "region")
_refuse("delete_parent_refused", _FAMILY.format(" ON DELETE RESTRICT"), "DELETE FROM r WHERE rk = 1", "r", _BOTH, "23503", 1451, "region")
_refuse("truncate_parent_refused", _FAMILY.format(""), "TRUNCATE TABLE r", "r", _BOTH, "23503", 1451, "region")

# -- namespaces

_SPACES = "CREATE TABLE events (id INT); INSERT INTO events VALUES (1); CREATE DATABASE analytics; USE analytics; CREATE TABLE events (id INT); INSERT INTO events VALUES (10), (20)"
register("use_database", _after(_SPACES, "SELECT id, current_database() AS d FROM events"), "SELECT * FROM (VALUES (10, 'analytics'), (20, 'analytics')) t(id, d)")
register("three_part_select", _after(_SPACES + "; INSERT INTO default.public.events VALUES (2); UPDATE default.public.events SET id = id + 1 WHERE id = 2; USE default", "SELECT a.id AS a, b.id AS b FROM events a CROSS JOIN analytics.public.events b"), "SELECT * FROM (VALUES (1, 10), (1, 20), (3, 10), (3, 20)) t(a, b)")
register("search_path_lookup", _after("CREATE TABLE shared (id INT); INSERT INTO shared VALUES (42); CREATE SCHEMA custom; SET search_path = 'custom, public'; CREATE TABLE own (id INT); INSERT INTO own VALUES (7)", "SELECT s.id AS s, o.id AS o, c.id AS c FROM shared s CROSS JOIN own o CROSS JOIN custom.own c"), "SELECT 42 AS s, 7 AS o, 7 AS c")
_refuse("drop_database_cascade", _SPACES + "; USE default; DROP DATABASE analytics", "SELECT * FROM analytics.public.events", "events", (), "3D000", 1049, "range(1)")
_refuse("drop_active_database_refused", _SPACES, "DROP DATABASE analytics", "events", (), "55006", 1105, "range(2)")
register("show_databases", lambda spark, d: (s := Session(spark)).run("CREATE DATABASE analytics; CREATE DATABASE IF NOT EXISTS analytics") and s.execute("SHOW DATABASES"), "SELECT * FROM (VALUES ('analytics'), ('default')) t(database_name)")

# -- transactions and settings

register("transaction_rollback", _after("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); DELETE FROM t WHERE a = 1; ROLLBACK", "SELECT a FROM t"), "SELECT 1 AS a")
register("transaction_savepoint", _after("CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT p; INSERT INTO t VALUES (2); ROLLBACK TO SAVEPOINT p; INSERT INTO t VALUES (3); RELEASE SAVEPOINT p; COMMIT", "SELECT a FROM t"), "SELECT * FROM (VALUES (1), (3)) t(a)")
register("transaction_isolation", _after("CREATE TABLE t (a INT); SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED; BEGIN; INSERT INTO t VALUES (1); COMMIT", "SELECT a, @@transaction_isolation AS i FROM t"), "SELECT 1 AS a, 'read committed' AS i")
register("autocommit_off", _after("CREATE TABLE t (a INT); SET autocommit = 0; INSERT INTO t VALUES (1); COMMIT; INSERT INTO t VALUES (2); ROLLBACK", "SELECT a, @@autocommit AS c FROM t"), "SELECT 1 AS a, 0 AS c")
register("on_error_ignore", _after("CREATE TABLE t (a INT PRIMARY KEY); SET on_error = 'ignore'; INSERT INTO t VALUES (1); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2)", "SELECT a FROM t"), "SELECT * FROM (VALUES (1), (2)) t(a)")


def _on_error(mode: str):
    def run(spark, sf_dir):
        s = Session(spark)
        s.run(f"CREATE TABLE t (a INT PRIMARY KEY); INSERT INTO t VALUES (1); SET on_error = {mode}; BEGIN; INSERT INTO t VALUES (2)")
        state, _ = _refused(s, "INSERT INTO t VALUES (1)")
        s.execute("COMMIT")
        return s.query(f"SELECT a, '{state}' AS state FROM t")

    return run


register("on_error_statement", _on_error("rollback_statement"), "SELECT * FROM (VALUES (1, '23505'), (2, '23505')) t(a, state)")
register("on_error_transaction", _on_error("rollback_transaction"), "SELECT 1 AS a, '23505' AS state")
register("compat_mysql", _after("CREATE TABLE t (s TEXT); INSERT INTO t VALUES ('Ana'), ('ÁNA'), ('Bo'); SET any_compat = 'mysql'", "SELECT min(s) AS s, count(*) AS n FROM t WHERE s = 'ana' GROUP BY s"), "SELECT 'Ana' AS s, 2 AS n")
register("sql_mode_lenient", _after("CREATE TABLE t (n INT); SET sql_mode = ''; INSERT INTO t VALUES ('42abc'), ('none')", "SELECT n, @@strict_mode AS m FROM t"), "SELECT * FROM (VALUES (42, 0), (0, 0)) t(n, m)")
register("show_variables", lambda spark, d: (s := Session(spark)).run("SET lock_timeout = 12; SET search_path = DEFAULT") and s.execute("SHOW VARIABLES LIKE 'lock%'"), "SELECT 'lock_timeout' AS variable_name, '12' AS value")
register("show_warnings", lambda spark, d: (s := Session(spark)).run("CREATE TABLE t (n INT); SET strict_mode = OFF; INSERT INTO t VALUES ('7x')") and s.execute("SHOW WARNINGS"), "SELECT 'Warning' AS level, 0 AS code, 'n was coerced' AS message")
register("show_status", lambda spark, d: (s := Session(spark)).run("SELECT 1 AS a; SELECT 2 AS b; CREATE TABLE t (n INT)") and s.execute("SHOW STATUS").filter("variable_name IN ('com_select', 'com_create', 'open_tables', 'questions')"), "SELECT * FROM (VALUES ('com_select', '2'), ('com_create', '1'), ('open_tables', '1'), ('questions', '4')) t(variable_name, value)")
register("show_processlist", lambda spark, d: Session(spark).execute("SHOW PROCESSLIST").select("db", "Command", "Time", "Info"), "SELECT 'default' AS db, 'Query' AS Command, 0 AS Time, 'SHOW PROCESSLIST' AS Info")


def explain_rows(spark, sf_dir):
    s = Session(spark).attach(sf_dir, ("customer",))
    s.run(_CUSTOMERS.format("PRIMARY KEY", "") + "; CREATE INDEX seg ON t (s)")
    out = None
    for where in ("", "WHERE k = 5", "WHERE s = 'x'", "WHERE k > 5 AND b < 0", "WHERE b < 0"):
        row = s.execute(f"EXPLAIN SELECT * FROM t {where}").drop("plan")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(s.execute("EXPLAIN DELETE FROM t").drop("plan"))


register("explain_rows", explain_rows, "SELECT 1 AS id, x.a AS select_type, x.b AS \"table\", x.c AS type, x.d AS possible_keys, x.e AS \"key\", CAST(NULL AS INT) AS key_len, x.f AS ref, CASE WHEN x.a = 'SIMPLE' THEN n END AS \"rows\", x.g AS Extra FROM (SELECT count(*) AS n FROM customer), (VALUES ('SIMPLE', 't', 'ALL', NULL, NULL, NULL, ''), ('SIMPLE', 't', 'const', 'PRIMARY', 'PRIMARY', 'const', 'Using where'), ('SIMPLE', 't', 'ref', 'seg', 'seg', 'const', 'Using where'), ('SIMPLE', 't', 'range', 'PRIMARY', 'PRIMARY', NULL, 'Using where; Using index condition'), ('SIMPLE', 't', 'ALL', NULL, NULL, NULL, 'Using where'), ('DELETE', '-', NULL, NULL, NULL, NULL, NULL)) x(a, b, c, d, e, f, g)")

# -- errors

_FAULTS = {
    "syntax": ("SELEC 1", "42601", 1064), "clause": ("SELECT a FROM nation LIMIT -1", "42601", 1064), "table": ("INSERT INTO nothing VALUES (1)", "42P01", 1146), "column": ("INSERT INTO t (z) VALUES (1)", "42703", 1054),
    "database": ("USE nothing", "3D000", 1049), "schema": ("CREATE TABLE nothing.t (a INT)", "3F000", 1049), "table twice": ("CREATE TABLE t (a INT)", "42P07", 1050), "database twice": ("CREATE DATABASE default", "42P04", 1007),
    "setting": ("SET collation = 'xx'", "22P02", 1231), "begin twice": ("BEGIN", "25001", 1568), "default values": ("INSERT INTO t DEFAULT VALUES", "0A000", 1235),
    "divide by zero": ("SELECT n_nationkey / (n_nationkey - n_nationkey) AS x FROM nation", "22012", 1365), "where": ("SELECT n_name FROM nation WHERE 1 % (n_nationkey - n_nationkey) = 1", "22012", 1365),
    "overflow": ("SELECT 2147483647 + n_nationkey AS x FROM nation", "22003", 1690), "decimal": ("SELECT CAST(n_nationkey + 12345 AS DECIMAL(4, 2)) AS x FROM nation", "22003", 1264),
    "cast": ("SELECT CAST(n_name AS INT) AS x FROM nation", "22018", 1366), "many rows": ("SELECT (SELECT n_name FROM nation) AS x", "21000", 1242),
}


def error_codes(spark, sf_dir):
    s = Session(spark).attach(sf_dir, ("nation",))
    s.run("CREATE TABLE t (a INT); BEGIN")
    return spark.createDataFrame([(name, *_refused(s, statement)) for name, (statement, _, _) in _FAULTS.items()], "fault string, sqlstate string, number int")


register("error_codes", error_codes, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{state}', {number})" for n, (_, state, number) in _FAULTS.items()) + ") t(fault, sqlstate, number)")


def group_star_refused(spark, sf_dir):
    s = Session(spark).attach(sf_dir, ("nation",))
    return s.query(f"SELECT {_refused(s, 'SELECT * FROM nation GROUP BY n_regionkey')[0] != '00000'} AS refused")


register("group_star_refused", group_star_refused, "SELECT true AS refused")

# -- the API


def api_results(spark, sf_dir):
    s = Session(spark).attach(sf_dir, ("nation", "region"))
    counts = [r.count for r in s.run("CREATE TABLE t (id INT AUTO_INCREMENT, v TEXT); INSERT INTO t (v) SELECT n_name FROM nation; UPDATE t SET v = 'x' WHERE id <= 3; DELETE FROM t WHERE v = 'x'; TRUNCATE TABLE t") if r is not None]
    first = s.execute("INSERT INTO t (v) VALUES (?), (?)", ("a;", "b")).last_insert_id
    names, rows = s.query_with_columns("SELECT r_regionkey AS k, r_name AS n FROM region ORDER BY r_regionkey")
    prepared = s.prepare("SELECT v FROM t WHERE id = ?").execute(2).first()["v"]
    return s.query(f"SELECT '{counts}' AS counts, {first} AS first_id, last_insert_id() AS last, '{','.join(names)}' AS names, {len(rows)} AS n, '{rows[0][1]}' AS first_row, '{prepared}' AS prepared")


register("api_results", api_results, "SELECT '[' || count(*) || ', 3, 3, 0]' AS counts, 1 AS first_id, CAST(1 AS BIGINT) AS last, 'k,n' AS names, CAST(5 AS INT) AS n, (SELECT r_name FROM region WHERE r_regionkey = 0) AS first_row, 'b' AS prepared FROM nation")
register("text_result", lambda s, d: Session(s).attach(d, ("customer",)).text_result("SELECT c_custkey, c_name, c_nationkey > 5 AS f, CAST('AB' AS BLOB) AS b, nullif(c_nationkey, 3) AS k FROM customer"), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_nationkey > 5 THEN '1' ELSE '0' END AS f, '4142' AS b, CAST(nullif(c_nationkey, 3) AS VARCHAR) AS k FROM customer")
register("user_function", lambda s, d: Session(s).attach(d, ("part",)).function("skarn_thrice", lambda x: x * 3, "long").query("SELECT p_partkey, skarn_thrice(p_size) AS x FROM part"), "SELECT p_partkey, CAST(p_size * 3 AS BIGINT) AS x FROM part")
