import pytest

from skarn.plans.dialect import SyntaxFault, Unsupported, rewrite, split_statements, tokens

SCHEMAS = {"t": [("a", "int"), ("b", "double"), ("s", "string"), ("f", "boolean")], "u": [("a", "bigint"), ("s", "string")]}


def spark_sql(sql, collation="binary"):
    return rewrite(sql, lambda parts: SCHEMAS.get(parts[-1]), collation)


@pytest.mark.parametrize(
    ("given", "part"),
    [
        ("SELECT a / 2 AS x FROM t", "(`a` div 2)"), ("SELECT 7 / 2 AS x", "cast(7 div 2 AS int)"), ("SELECT b / 0 AS x FROM t", "Infinity"),
        ("SELECT 1.5 AS x", "1.5D"), ("SELECT a FROM t ORDER BY a", "ASC NULLS LAST"), ("SELECT a FROM t ORDER BY a DESC", "DESC NULLS FIRST"),
        ("SELECT a FROM t ORDER BY a DESC NULLS LAST", "DESC NULLS LAST"), ('SELECT "a" FROM t', "`a`"), ("SELECT f = 1 AS x FROM t", "cast(`f` AS int)"),
        ("SELECT a FROM t WHERE s LIKE 'x\\\\y'", "'x\\\\\\\\y'"), ("SELECT a FROM t WHERE s LIKE '5!%' ESCAPE '!'", "'5\\\\%'"),
        ("SELECT t.a FROM t JOIN u USING (a, s)", "`t`.`a` = `u`.`a` AND `t`.`s` = `u`.`s`"), ("SELECT s, b FROM t GROUP BY s", "first(`b`)"),
        ("SELECT avg(a) AS x FROM t", "avg(cast(`a` AS double))"), ("SELECT a FROM t LIMIT '3' OFFSET 2", "LIMIT 3 OFFSET 2"),
        ("SELECT group_concat(DISTINCT s ORDER BY a DESC SEPARATOR '|') AS x FROM t", "array_distinct"), ("SELECT LEFT(s, 2) AS x FROM t", "left(`s`, 2)"),
        ("SELECT current_timestamp AS x", "timestamp_ntz"), ("SELECT CAST(a AS VARCHAR(10)) AS x FROM t", "cast(`a` AS string)"), ("SELECT cast(s AS DECIMAL(10, 2)) AS x FROM t", "decimal(10, 2)"), ("SELECT cast(s AS DECIMAL) AS x FROM t", "decimal(38, 10)"),
        ("SELECT a -- note\n /* more */ FROM t # end", "FROM `t`"), ("SELECT EXTRACT(YEAR FROM s) AS x FROM t", "extract(YEAR FROM s)"),
    ],
)
def test_rewrites(given, part):
    assert part in spark_sql(given)


def test_collation_folds_texts_only():
    sql = spark_sql("SELECT s, count(*) AS n FROM t WHERE s = 'É' AND a = 1 GROUP BY s ORDER BY s", "es")
    assert sql.count("translate(") == 4 and "min(`s`)" in sql and "(`a` = 1)" in sql
    assert "translate(" in spark_sql("SELECT DISTINCT s, a FROM t", "es")


@pytest.mark.parametrize("bad", ["SELECT", "SELECT a FROM", "SELECT a FROM t LIMIT -1", "SELECT a FROM t OFFSET 2", "SELECT a FROM t LIMIT 1.5", "SELECT (a FROM t", "SELECT a FROM t JOIN u", "SELECT 'open", "SELECT cast(a AS thing) FROM t"])
def test_faults(bad):
    with pytest.raises(SyntaxFault):
        spark_sql(bad)


@pytest.mark.parametrize(
    ("given", "parts"),
    [
        ("SELECT a / 2 AS x FROM t UNION ALL SELECT a FROM u ORDER BY x LIMIT 3", ["(`a` div 2)", "UNION ALL SELECT", "ORDER BY `x` ASC NULLS LAST LIMIT 3"]),
        ("WITH c AS (SELECT a / 2 AS h FROM t) SELECT h / 2 AS q FROM c ORDER BY h", ["WITH `c` AS (SELECT (`a` div 2)", "(`h` div 2)", "FROM `c` AS `c`", "NULLS LAST"]),
        ("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i / 2 < 3) SELECT i FROM n", ["WITH RECURSIVE `n` (`i`)", "(`i` div 2)"]),
        ("SELECT rank() OVER (PARTITION BY s ORDER BY a DESC) AS r FROM t", ["rank() OVER (PARTITION BY `s` ORDER BY `a` DESC NULLS FIRST)"]),
        ("SELECT sum(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS r FROM t", ["ORDER BY `a` ASC NULLS LAST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW"]),
        ("SELECT t.a FROM t, u WHERE t.a = u.a", ["FROM `t` AS `t`, `u` AS `u`"]),
        ("SELECT s, a, count(*) AS n FROM t GROUP BY ROLLUP (s, a)", ["GROUP BY ROLLUP (`s`, `a`)", "SELECT `s` AS `s`, `a` AS `a`"]),
        ("SELECT s, count(*) FILTER (WHERE a / 2 = 1) AS n FROM t GROUP BY s", ["count(*) FILTER (WHERE ((`a` div 2) = 1))"]),
        ("SELECT greatest(a, 7 / 2) AS g FROM t", ["greatest(`a`, cast(7 div 2 AS int))"]),
        ("SELECT a FROM t WHERE a NOT IN (SELECT a FROM u)", ["NOT EXISTS", "`a` IS NOT NULL"]),
        ("SELECT a FROM t WHERE NOT (a NOT IN (SELECT a FROM u))", ["`a` NOT IN (SELECT"]),
        ("SELECT a FROM t WHERE (a NOT IN (SELECT a FROM u)) = TRUE", ["`a` NOT IN (SELECT"]),
        ("(SELECT a FROM t) EXCEPT (SELECT a FROM u) ORDER BY a", ["EXCEPT (SELECT", "NULLS LAST"]),
        ("SELECT DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 03:04:05' + INTERVAL 1 DAY AS e", ["DATE '2024-01-02'", "INTERVAL 1 DAY"]),
    ],
)
def test_beyond_the_dialect_its_rules_hold(given, parts):
    sql = spark_sql(given)
    for part in parts:
        assert part in sql, sql


@pytest.mark.parametrize("other", ["SELECT listagg(s) WITHIN GROUP (ORDER BY s) FROM t", "SELECT a FROM t LATERAL VIEW explode(array(1)) x AS e", "SELECT a::int FROM t"])
def test_what_is_left_to_spark(other):
    with pytest.raises(SyntaxFault):
        spark_sql(other)


def test_texts_and_scripts():
    assert tokens(r"'a\'b''c\n'")[0].value == "a'b'c\n"
    assert split_statements("SELECT ';' ; -- x;y\n SELECT 2;; ") == ["SELECT ';'", "-- x;y\n SELECT 2"]
