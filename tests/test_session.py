import io

import pytest

import skarn
from skarn.cli import Shell
from skarn.session import Affected, EngineError, NotFound, Session


def rows(session, sql, params=()):
    return sorted((tuple(r) for r in session.query(sql, params).collect()), key=repr)


@pytest.fixture
def shop(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}")
    s.run("""
        CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, role TEXT DEFAULT 'user');
        CREATE TABLE orders (id INT PRIMARY KEY AUTO_INCREMENT, user_id INT REFERENCES users(id) ON DELETE CASCADE, total INT CHECK (total > 0));
        INSERT INTO users VALUES (1, 'Ana', 'admin'), (2, 'Bo', NULL), (3, 'Chi', 'user');
        INSERT INTO orders (user_id, total) VALUES (1, 10), (1, 20), (2, 5), (NULL, 7);
    """)
    return s


def test_joins_and_groups(shop):
    assert rows(shop, "SELECT u.name AS n, o.total AS t FROM users u LEFT JOIN orders o ON u.id = o.user_id") == [("Ana", 10), ("Ana", 20), ("Bo", 5), ("Chi", None)]
    assert rows(shop, "SELECT u.id AS a, o.id AS b FROM users u FULL JOIN orders o ON u.id = o.user_id WHERE u.id IS NULL OR o.id IS NULL") == [(3, None), (None, 4)]
    assert rows(shop, "SELECT user_id, sum(total) AS s, group_concat(total ORDER BY total DESC) AS g FROM orders GROUP BY user_id HAVING count(*) > 1") == [(1, 30, "20,10")]
    assert rows(shop, "SELECT name FROM users u WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id)") == [("Chi",)]


def test_constraints(shop):
    for bad in (
        "INSERT INTO users VALUES (1, 'dup', NULL)", "INSERT INTO users VALUES (4, NULL, NULL)", "INSERT INTO orders (user_id, total) VALUES (9, 1)",
        "INSERT INTO orders (user_id, total) VALUES (1, 0)", "UPDATE users SET id = 2 WHERE id = 1", "UPDATE users SET id = 50 WHERE id = 1", "TRUNCATE TABLE users",
    ):
        with pytest.raises(EngineError):
            shop.execute(bad)
    assert len(rows(shop, "SELECT * FROM users")) == 3 and len(rows(shop, "SELECT * FROM orders")) == 4


def test_update_delete_and_cascade(shop):
    assert shop.execute("UPDATE orders SET total = total * 2 WHERE user_id = ?", (1,)) == Affected(2)
    assert rows(shop, "SELECT total FROM orders") == [(20,), (40,), (5,), (7,)]
    assert shop.execute("DELETE FROM users WHERE name LIKE 'A%'") == Affected(1)
    assert rows(shop, "SELECT user_id FROM orders") == [(2,), (None,)]


def test_auto_increment_and_last_id(shop):
    assert shop.execute("INSERT INTO orders (user_id, total) VALUES (2, 1), (2, 2)") == Affected(2, 5)
    assert rows(shop, "SELECT last_insert_id() AS i") == [(5,)]
    shop.execute("INSERT INTO orders VALUES (40, 3, 9)")
    assert shop.execute("INSERT INTO orders (total) VALUES (3)").last_insert_id == 41


def test_transactions(shop):
    shop.begin()
    shop.execute("DELETE FROM orders")
    shop.execute("SAVEPOINT a")
    shop.execute("INSERT INTO users VALUES (8, 'H', NULL)")
    shop.execute("ROLLBACK TO SAVEPOINT a")
    assert len(rows(shop, "SELECT * FROM users")) == 3
    shop.rollback()
    assert len(rows(shop, "SELECT * FROM orders")) == 4
    shop.begin()
    shop.execute("DELETE FROM orders WHERE id = 1")
    shop.commit()
    shop.rollback()
    assert len(rows(shop, "SELECT * FROM orders")) == 3
    with pytest.raises(NotFound):
        shop.execute("RELEASE SAVEPOINT nothing")


def test_on_error_modes(shop):
    shop.execute("SET on_error = 'ignore'")
    assert shop.execute("INSERT INTO users VALUES (1, 'x', NULL)") == Affected(0)
    assert shop.execute("SHOW WARNINGS").count() == 1
    shop.execute("SET on_error = rollback_transaction")
    shop.begin()
    shop.execute("DELETE FROM orders")
    with pytest.raises(EngineError):
        shop.execute("INSERT INTO users VALUES (1, 'x', NULL)")
    assert len(rows(shop, "SELECT * FROM orders")) == 4
    with pytest.raises(EngineError):
        shop.execute("SET on_error = nonsense")


def test_ddl(shop):
    shop.run("ALTER TABLE users ADD COLUMN age INT DEFAULT 30; ALTER TABLE users ADD CONSTRAINT adult CHECK (age >= 18); ALTER TABLE users RENAME COLUMN name TO label")
    assert rows(shop, "SELECT label, age FROM users WHERE id = 2") == [("Bo", 30)]
    with pytest.raises(EngineError):
        shop.execute("INSERT INTO users VALUES (9, 'kid', NULL, 3)")
    shop.run("ALTER TABLE users DROP CONSTRAINT adult; INSERT INTO users VALUES (9, 'kid', NULL, 3); ALTER TABLE users DROP COLUMN age; ALTER TABLE users REBUILD")
    shop.run("CREATE UNIQUE INDEX one_label ON users (label) WHERE role IS NULL; CREATE INDEX IF NOT EXISTS plain ON orders USING btree (total DESC) INCLUDE (user_id)")
    with pytest.raises(EngineError):
        shop.execute("INSERT INTO users VALUES (10, 'Bo', NULL)")
    shop.run("INSERT INTO users VALUES (10, 'Bo', 'user'); DROP INDEX one_label ON users; DROP TABLE orders; DROP TABLE IF EXISTS orders, nothing")
    with pytest.raises(EngineError):
        shop.query("SELECT * FROM nowhere").collect()
    shop.run("CREATE DATABASE d; USE d; CREATE SCHEMA IF NOT EXISTS d; USE default; DROP DATABASE d")
    with pytest.raises(NotFound):
        shop.execute("USE d")
    with pytest.raises(EngineError):
        shop.execute("ALTER TABLE users MODIFY COLUMN id BIGINT")


def test_set_null_and_restrict(spark):
    for action, ok in (("SET NULL", True), ("RESTRICT", False), ("NO ACTION", False)):
        s = Session(spark)
        s.run(f"CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (k INT, FOREIGN KEY (k) REFERENCES p(k) ON DELETE {action}); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1), (1), (NULL)")
        if ok:
            s.execute("DELETE FROM p WHERE k = 1")
            assert rows(s, "SELECT k FROM c") == [(None,)] * 3
        else:
            with pytest.raises(EngineError):
                s.execute("DELETE FROM p WHERE k = 1")
            assert s.execute("DELETE FROM p WHERE k = 2") == Affected(1)


def test_lenient_coercion(spark):
    s = Session(spark)
    s.run("SET strict_mode = 0; CREATE TABLE t (n INT, r DOUBLE); INSERT INTO t VALUES ('42abc', '1.5x'), ('none', ' -2e1')")
    assert rows(s, "SELECT * FROM t") == [(0, -20.0), (42, 1.5)] and s.warnings


def test_prepared_settings_and_show(shop):
    statement = shop.prepare("SELECT name FROM users WHERE id = ? OR name = ?")
    assert [tuple(r) for r in statement.execute(1, "none").collect()] == [("Ana",)]
    assert shop.query_with_columns("SELECT id FROM users WHERE id = 1") == (["id"], [(1,)])
    shop.run("SET any_compat = mysql")
    assert rows(shop, "SELECT name FROM users WHERE name = 'ÁNA'") == [("Ana",)]
    shop.run("SET compat = DEFAULT; SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED")
    assert shop.settings.transaction_isolation == "read committed" and shop.settings.active_collation() == "binary"
    assert [r[0] for r in shop.execute("SHOW TABLES").collect()] == ["orders", "users"]
    assert {r["field"]: r["key"] for r in shop.execute("DESCRIBE users").collect()}["id"] == "PRI"
    assert {r.column_name: (r.row_count, r.ndv) for r in shop.execute("ANALYZE TABLE orders (user_id, total)").collect()} == {"user_id": (4, 2), "total": (4, 4)}
    assert "Physical Plan" in shop.execute("EXPLAIN SELECT * FROM users").first()["plan"]
    for what in ("DATABASES", "VARIABLES", "STATUS", "PROCESSLIST"):
        assert shop.execute(f"SHOW {what}").count() > 0
    with pytest.raises(EngineError):
        shop.execute("FROBNICATE")


def test_shell(spark):
    out = io.StringIO()
    shell = Shell(skarn.open(spark), out)
    for line in (".help", "CREATE TABLE t (a INT);", "INSERT INTO t", "VALUES (1), (NULL);", "SELECT a FROM t ORDER BY a;", "SELECT nothing FROM t;", ".tables", ".timer on", "SELECT 1 AS one;"):
        assert shell.line(line)
    assert not shell.line(".quit")
    text = out.getvalue()
    assert "2 rows affected" in text and "a\n1\nNULL" in text and "error:" in text and " s\n" in text


def test_parameters_in_dml(spark):
    s = Session(spark)
    s.execute("CREATE TABLE t (a INT, b TEXT)")
    assert s.execute("INSERT INTO t VALUES (?, ?), (2, '?')", (1, "q'")) == Affected(2)
    s.execute("INSERT INTO t SELECT a + ?, b FROM t WHERE b = ?", (10, "?"))
    s.execute("UPDATE t SET b = ? WHERE a = ?", ("n\\ew", 2))
    assert s.execute("DELETE FROM t WHERE a = ?", (1,)) == Affected(1)
    assert rows(s, "SELECT a, b FROM t") == [(12, "?"), (2, "n\\ew")]
