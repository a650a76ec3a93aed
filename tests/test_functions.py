import datetime

import pytest

from skarn.functions import scalar
from skarn.functions.collation import fold
from skarn.session import Session


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("trim('\\t a \u00a0')", "a"), ("substr('hello', 0, 2)", "he"), ("substr('hello', -3)", ""), ("mid('hello', 2, -1)", ""), ("substr(NULL, 1)", None),
        ("concat('a', NULL, 1)", "a1"), ("concat_ws(NULL, 'a')", None), ("repeat('a', -2)", ""), ("replace('abc', '', '-')", "-a-b-c-"), ("replace('', '', 'x')", "x"),
        ("left('abc', NULL)", ""), ("right('abc', 2)", "bc"), ("lpad('abcdef', 3)", "abc"), ("lpad('a', 4, 'xy')", "xyxa"), ("locate('b', NULL)", 0), ("instr('ab', 'b')", 2),
        ("ascii('é')", 233), ("ascii('')", 0), ("char(128512)", "😀"), ("char(55296)", ""), ("char(-1)", ""), ("space(NULL)", ""), ("strcmp('a', 'b')", -1), ("strcmp(NULL, 'b')", None),
        ("ceil(2)", 2.0), ("floor(-1.5)", -2.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(7)", 7), ("round(1.005, 2)", 1.0), ("pow(2, 10)", 1024.0), ("mod(-7, 3)", -1), ("sign(-3)", -1), ("sign(0.0)", 0.0),
        ("isnull(NULL)", True), ("if(NULL, 1, 2)", 2), ("typeof(1)", "Int"), ("typeof(1.5)", "Real"), ("typeof('a')", "Text"), ("typeof(NULL)", "NULL"), ("typeof(TRUE)", "Bool"),
        ("find_in_set('B', 'a,b')", 2), ("find_in_set('z', 'a,b')", 0), ("encode('AB', 'hex')", "4142"), ("to_base64('AB')", "QUI="), ("is_valid_uuid('550E8400-e29b41d4a716446655440000')", True), ("is_valid_uuid('x')", False),
        ("from_base64('!')", None), ("datediff(CAST('2024-03-01' AS DATE), CAST('2024-02-28' AS DATE))", 2), ("year(CAST('2024-03-01' AS DATE))", 2024),
        ("date_format(CAST('2024-03-01' AS DATE), '')", None), ("date_format(NULL, '%Y')", None), ("date_format(CAST('2024-03-05' AS DATE), '%e/%c/%y %Q %% it''s')", "5/3/24 %Q % it's"),
        ("date_format('2024-03-05 06:07:08', '%H-%i-%s')", "06-07-08"),
        ("str_to_date('2024-2-9', '%Y-%m-%d')", datetime.date(2024, 2, 9)), ("str_to_date('2024-02-30', '%Y-%m-%d')", None), ("str_to_date('x', '%Y')", None),
        ("str_to_date('69-01-02', '%y-%m-%d')", datetime.date(2069, 1, 2)), ("str_to_date('70-01-02', '%y-%m-%d')", datetime.date(1970, 1, 2)),
        ("str_to_date('(09.02.2024) 7h', '(%d.%m.%Y) %Hh')", datetime.datetime(2024, 2, 9, 7)), ("str_to_date(NULL, '%Y')", None),
        ("1 / 0.0", float("inf")), ("-1 / 0.0", float("-inf")), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("TRUE = 1", True), ("'a' || NULL", None), ("1 IN (2, NULL)", None),
    ],
)
def test_values(spark, call, want):
    assert Session(spark).query(f"SELECT {call} AS x").first()["x"] == want


def test_nan_and_errors(spark):
    s = Session(spark)
    value = s.query("SELECT 0 / 0.0 AS x").first()["x"]
    assert value != value
    for bad in ("SELECT 2147483647 + 1 AS x", "SELECT 1 % 0 AS x", "SELECT 1 / 0 AS x", "SELECT CAST('42abc' AS INT) AS x", "SELECT (SELECT 1 UNION ALL SELECT 2) AS x"):
        with pytest.raises(Exception):  # noqa: B017
            s.query(bad).collect()
    with pytest.raises(scalar.FunctionError):
        scalar.sql_of("no_such", [])
    with pytest.raises(scalar.FunctionError):
        scalar.sql_of("substr", ["a"])


def test_every_name_has_sql(spark):
    for name in scalar.NAMES:
        for n in range(5):
            try:
                sql, _ = scalar.sql_of(name, ["'2'", "'base64'", "'1'", "'1'"][:n] if name in ("encode", "decode") else ["'2'", "'%Y'", "'1'", "'1'"][:n])
                break
            except scalar.FunctionError:
                continue
        else:
            raise AssertionError(name)
        assert sql


def test_columns(spark):
    frame = spark.createDataFrame([(" Ñandú ", "ÀB")], "a string, b string")
    assert frame.select(scalar.call("trim", "a").alias("x"), fold("a").alias("y"), fold("b").alias("z")).first() == ("Ñandú", " nandu ", "ab")
