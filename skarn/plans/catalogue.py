"""The query catalogue: one query per operator, in the dialect or the DataFrame API, with its oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.functions import scalar
from skarn.operators import relational as rel
from skarn.operators import tables as tb
from skarn.plans.registry import register
from skarn.session import DRIVER_TABLES, Session
from skarn.sources.tables import table


def dialect(name: str, sql: str, oracle: str | None = "", params: tuple = (), collation: str = "binary") -> None:
    """Register a query of the dialect; the oracle is the same text where it isn't given."""
    used = tuple(t for t in DRIVER_TABLES if re.search(rf"\b{t}\b", sql))

    def run(spark, sf_dir):
        session = Session(spark).attach(sf_dir, used)
        session.settings.collation = collation
        return session.query(sql, params)

    register(name, run, sql if oracle == "" else oracle)


FLAGSHIP = """
SELECT n.n_name AS nation, count(*) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name HAVING count(*) > 100 ORDER BY revenue DESC NULLS FIRST, nation ASC NULLS LAST LIMIT 10
"""
dialect("flagship", FLAGSHIP)

# -- A: scans and filters

dialect("scan_full", "SELECT * FROM part")
dialect("scan_project_alias", "SELECT c_custkey AS k, c_acctbal * 2 AS twice FROM customer")
dialect("scan_qualified_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")
dialect("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02 AND l_returnflag <> 'R'")
dialect("filter_and_or_not", "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_nationkey = 3) AND NOT c_mktsegment = 'BUILDING'")
dialect("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
dialect("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20")
dialect("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
dialect("filter_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, NULL) OR c_nationkey IN (5, NULL)")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
dialect("filter_not_like", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'S%' AND p_brand LIKE '%1%'")
dialect("filter_like_escape", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer!_%' ESCAPE '!' OR c_name LIKE '%#0000001%'")
dialect("filter_is_null", "SELECT o.o_orderkey AS k, l.l_orderkey IS NULL AS unmatched FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber IS NULL OR l.l_quantity IS NOT NULL AND l.l_quantity > 49")
dialect("filter_bool_int", "SELECT c_custkey, (c_acctbal > 0) = 1 AS positive FROM customer WHERE (c_nationkey = 7) = TRUE OR (c_acctbal < 0) = 1", "SELECT c_custkey, (c_acctbal > 0) AS positive FROM customer WHERE c_nationkey = 7 OR c_acctbal < 0")
dialect("pk_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
dialect("pk_lookup_param", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = ? OR c_name = ?", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 78 OR c_name = 'Customer#000000012'", params=(78, "Customer#000000012"))
dialect("pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 400")
dialect("count_star_fast", "SELECT count(*) AS n FROM lineitem")
dialect("select_no_from", "SELECT 1 AS one, 'a' AS a, NULL IS NULL AS t", "SELECT 1 AS one, 'a' AS a, true AS t")
dialect("derived_table", "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE d.n > 10")

# -- B: expressions

dialect("arith_int_div_mod", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size / 4 AS nq, -p_size % 4 AS nr, p_size * 2 - 3 AS e FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS r, CAST(-(p_size // 4) AS BIGINT) AS nq, -p_size % 4 AS nr, p_size * 2 - 3 AS e FROM part")
dialect("arith_overflow_guard", "SELECT p_partkey, CAST(p_size AS BIGINT) * 3000000000 AS big FROM part")
dialect("arith_real_ieee", "SELECT c_custkey, c_acctbal / 0.0 AS inf, round(c_acctbal / 3.0, 4) AS third FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Infinity'::DOUBLE WHEN c_acctbal < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS inf, round(c_acctbal / 3.0, 4) AS third FROM customer")
dialect("concat_op", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS TEXT) AS tag FROM nation")
dialect("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, CASE WHEN c_nationkey > 20 THEN 1 END AS late FROM customer")
dialect("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
dialect("cast_matrix", "SELECT c_custkey, CAST(c_custkey AS TEXT) AS t, CAST(c_nationkey AS BIGINT) AS b, CAST(c_nationkey AS DOUBLE) AS d, CAST('42' AS INT) AS i, CAST(c_nationkey AS BOOL) AS f, CAST(CAST('2024-02-29' AS DATE) AS TIMESTAMP) AS ts FROM customer")
register("coerce_permissive", lambda s, d: table(s, d, "events").select("event_id", F.expr(scalar.to_number_permissive("concat(cast(event_id as string), 'abc')")).alias("prefix"), F.expr(scalar.to_number_permissive("event_type")).alias("garbage"), F.expr(scalar.to_number_permissive("concat('  -', event_id, '.5x')", "real")).alias("real")), "SELECT event_id, event_id AS prefix, CAST(0 AS BIGINT) AS garbage, CAST('-' || event_id || '.5' AS DOUBLE) AS real FROM events")
dialect("unary_neg", "SELECT c_custkey, -c_acctbal AS neg, - -c_nationkey AS pos FROM customer")
dialect("three_valued_logic", "SELECT d.doc_id AS k, (l.quality = 1) AND (d.n_chars > 500) AS a, (l.quality = 1) OR (d.n_chars > 500) AS o, NOT (l.toxic = 1) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

# -- C: joins

dialect("join_inner", "SELECT c.c_name AS name, o.o_orderkey AS k FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000")
dialect("join_left", "SELECT c.c_custkey AS k, e.event_id AS e FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id")
dialect("join_right", "SELECT e.event_id AS e, c.c_custkey AS k FROM events e RIGHT OUTER JOIN customer c ON c.c_custkey = e.user_id")
dialect("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3) a FULL JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1) b ON a.k = b.k")
dialect("join_cross", "SELECT r.r_name AS r, n.n_name AS n FROM region r CROSS JOIN nation n")
dialect("join_using", "SELECT d.doc_id AS a, l.doc_id AS b, l.quality AS q FROM documents d JOIN labels l USING (doc_id)")
dialect("join_full_using", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 9) a FULL JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1) b USING (k)")
dialect("join_three", "SELECT o.o_orderkey AS k, c.c_name AS c, n.n_name AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
dialect("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey OR a.n_nationkey = b.n_nationkey + 20")
dialect("join_multi_key", "SELECT l.l_orderkey AS k, l.l_linenumber AS n, s.s_name AS s FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND l.l_linenumber = s.s_nationkey")
dialect("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.value > 10)")
dialect("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)")
dialect("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
dialect("anti_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
dialect("left_join_where_null", "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
register("join_salted", lambda s, d: rel.salted_join(table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_quantity"), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k").groupBy("s_name").agg(F.count("*").alias("n")), "SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")

# -- D: aggregation

dialect("agg_count_star", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
dialect("agg_count_col", "SELECT d.lang AS lang, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
dialect("agg_sum_min_max", "SELECT p_brand, sum(p_size) AS s, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand")
dialect("agg_min_max_timestamp", "SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_orderpriority")
dialect("agg_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS a, round(avg(c_nationkey), 4) AS b FROM customer GROUP BY c_mktsegment")
dialect("agg_expr_arg", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(1) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("group_single_int", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
dialect("group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
dialect("group_text", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
dialect("group_null_key", "SELECT l.quality AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality")
dialect("group_expr", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1")
dialect("group_case", "SELECT CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS band, count(*) AS n FROM part GROUP BY CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END")
dialect("having_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 100000")
dialect("having_group_concat", "SELECT p_brand FROM part GROUP BY p_brand HAVING GROUP_CONCAT(DISTINCT p_type ORDER BY p_type) LIKE '%S%'", "SELECT p_brand FROM part GROUP BY p_brand HAVING string_agg(DISTINCT p_type, ',' ORDER BY p_type) LIKE '%S%'")
dialect("agg_empty", "SELECT count(*) AS n, sum(p_size) AS s, min(p_name) AS m, avg(p_size) AS a FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS m, avg(p_size) AS a FROM part WHERE p_size < 0")
dialect("group_concat_basic", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect("group_concat_sep", "SELECT n_regionkey, GROUP_CONCAT(n_nationkey ORDER BY n_nationkey DESC SEPARATOR ' | ') AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ' | ' ORDER BY n_nationkey DESC) AS ids FROM nation GROUP BY n_regionkey")
dialect("group_concat_distinct", "SELECT p_brand, GROUP_CONCAT(DISTINCT p_type ORDER BY p_type SEPARATOR '|') AS types FROM part GROUP BY p_brand", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
dialect("group_concat_order", "SELECT o_custkey, GROUP_CONCAT(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ks FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS ks FROM orders GROUP BY o_custkey")
register("group_concat_frame", lambda s, d: table(s, d, "part").groupBy("p_brand").agg(rel.group_concat("p_size", "-", distinct=True, order="p_size", descending=True).alias("sizes")), "SELECT p_brand, string_agg(CAST(p_size AS VARCHAR), '-' ORDER BY p_size DESC) AS sizes FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
dialect("group_concat_nulls", "SELECT d.lang AS lang, d.source AS source, GROUP_CONCAT(l.quality ORDER BY l.quality) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, d.source", "SELECT d.lang AS lang, d.source AS source, string_agg(CAST(l.quality AS VARCHAR), ',' ORDER BY l.quality) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, d.source")
dialect("string_agg", "SELECT r_regionkey, string_agg(r_name, ';') AS names FROM region GROUP BY r_regionkey")
dialect("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
dialect("distinct_with_limit", "SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5", "SELECT DISTINCT p_size FROM part ORDER BY p_size DESC NULLS FIRST LIMIT 5")
register("group_first_row_value", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(rel.first_row_value("o_orderpriority", "o_orderkey").alias("first_priority"), F.count("*").alias("n")), "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n FROM orders GROUP BY o_custkey")
dialect("group_dependent_column", "SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey", "SELECT n_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
_WORD_FOLDED = "strip_accents(lower(split_part(text, ' ', 1)))"
register("group_collation_es", lambda s, d: rel.group_folded(table(s, d, "documents").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("w")), "w", F.count("*").alias("n")), f"SELECT min(split_part(text, ' ', 1)) AS w, count(*) AS n FROM documents GROUP BY {_WORD_FOLDED}")
register("distinct_collation_es", lambda s, d: rel.distinct_folded(table(s, d, "documents").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("w"), "lang"), ["w"]), f"SELECT min(split_part(text, ' ', 1)) AS w, lang FROM documents GROUP BY {_WORD_FOLDED}, lang")
dialect("group_collation_es_sql", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE source <> 'SRC0' GROUP BY source", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE source <> 'src0' GROUP BY source", collation="es")
dialect("filter_collation_es", "SELECT doc_id FROM documents WHERE source = 'SRC3' AND text LIKE '%QUE LÁ%' OR lang IN ('És')", "SELECT doc_id FROM documents WHERE source = 'src3' AND strip_accents(lower(text)) LIKE '%que la%' OR lang = 'es'", collation="es")

# -- the shapes of the published benchmarks over the large table

dialect("scan_wide", "SELECT * FROM lineitem")
dialect("group_int_large", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
dialect("group_avg_large", "SELECT l_linenumber, round(avg(l_quantity), 4) AS q, round(avg(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_linenumber")
dialect("left_join_large", "SELECT o.o_orderkey AS k FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")

# -- E: order, limit, subqueries

dialect("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey")
dialect("order_nulls_default", "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id", "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id NULLS LAST")
dialect("order_nulls_explicit", "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id")
dialect("order_expr", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * -1, p_partkey")
dialect("order_grouped", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 7")
dialect("limit_only", "SELECT r_name FROM region LIMIT 100")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
dialect("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
dialect("scalar_subquery_select", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS top FROM customer WHERE c_nationkey = 4")
dialect("scalar_subquery_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
dialect("scalar_subquery_empty", "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey = 999) AS none FROM region")
dialect("correlated_scalar", "SELECT c_custkey AS k, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c")
dialect("correlated_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
dialect("derived_grouped", "SELECT d.b AS b, max(d.n) AS m FROM (SELECT p_brand AS b, p_type AS t, count(*) AS n FROM part GROUP BY p_brand, p_type) d GROUP BY d.b")
dialect("derived_in_join", "SELECT c.c_custkey AS k, d.n AS n FROM customer c JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d ON c.c_custkey = d.k WHERE d.n > 12")
dialect("nested_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50))")

# -- F: scalar functions

dialect("str_length", "SELECT doc_id, length(text) AS n, char_length(source) AS c, octet_length(text) AS b FROM documents", "SELECT doc_id, CAST(length(text) AS INT) AS n, CAST(length(source) AS INT) AS c, CAST(strlen(text) AS INT) AS b FROM documents")
dialect("str_case", "SELECT p_partkey, upper(p_name) AS u, ucase(p_type) AS uc, lower(p_brand) AS l, lcase(p_name) AS lc FROM part", "SELECT p_partkey, upper(p_name) AS u, upper(p_type) AS uc, lower(p_brand) AS l, lower(p_name) AS lc FROM part")
dialect("str_trim", "SELECT n_nationkey, trim('\\t ' || n_name || '\\n ') AS t, ltrim('  \\t' || n_name || ' ') || '|' AS l, rtrim(' ' || n_name || '\\t ') || '|' AS r FROM nation", "SELECT n_nationkey, n_name AS t, n_name || ' |' AS l, ' ' || n_name || '|' AS r FROM nation")
dialect("str_substr", "SELECT n_nationkey, substr(n_name, 2, 3) AS a, substring(n_name, 0, 2) AS z, mid(n_name, -2, 2) AS neg, substr(n_name, 3) AS t, substr(n_name, 2, -1) AS m, left(n_name, 2) AS l, right(n_name, 2) AS r, left(n_name, -1) AS e FROM nation", "SELECT n_nationkey, substr(n_name, 2, 3) AS a, substr(n_name, 1, 2) AS z, '' AS neg, substr(n_name, 3) AS t, '' AS m, left(n_name, 2) AS l, right(n_name, 2) AS r, '' AS e FROM nation")
dialect("str_concat", "SELECT d.doc_id AS k, concat(d.lang, ':', l.quality, '!') AS c, concat_ws('-', d.lang, l.quality, d.source) AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id AS k, concat(d.lang, ':', l.quality, '!') AS c, concat_ws('-', d.lang, l.quality, d.source) AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
dialect("str_pad", "SELECT n_nationkey, lpad(n_name, 12, 'xy') AS l, rpad(n_name, 4, '.') AS r, lpad(n_name, 10) AS d, repeat('ab', n_regionkey) AS rep, replicate('z', -1) AS none FROM nation", "SELECT n_nationkey, lpad(n_name, 12, 'xy') AS l, rpad(n_name, 4, '.') AS r, lpad(n_name, 10, ' ') AS d, repeat('ab', n_regionkey) AS rep, '' AS none FROM nation")
dialect("str_locate", "SELECT p_partkey, locate('a', p_name) AS l, position('zz', p_name) AS p, instr(p_name, 'e') AS i, locate(NULL, p_name) AS n FROM part", "SELECT p_partkey, CAST(instr(p_name, 'a') AS INT) AS l, CAST(instr(p_name, 'zz') AS INT) AS p, CAST(instr(p_name, 'e') AS INT) AS i, 0 AS n FROM part")
dialect("str_misc", "SELECT n_nationkey, reverse(n_name) AS r, replace(n_name, 'A', '__') AS p, replace('ab', '', '-') AS e, ascii(n_name) AS a, ascii('') AS a0, char(n_nationkey + 65) AS c, chr(8364) AS euro, space(3) || '|' AS s, strcmp(n_name, 'FRANCE') AS cmp FROM nation", "SELECT n_nationkey, reverse(n_name) AS r, replace(n_name, 'A', '__') AS p, '-a-b-' AS e, CAST(unicode(n_name) AS INT) AS a, 0 AS a0, chr(n_nationkey + 65) AS c, '€' AS euro, '   |' AS s, CASE WHEN n_name < 'FRANCE' THEN -1 WHEN n_name > 'FRANCE' THEN 1 ELSE 0 END AS cmp FROM nation")
dialect("num_all", "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_nationkey) AS ai, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, round(c_nationkey) AS ri, round(c_acctbal, 1) AS r1, pow(c_nationkey, 2) AS p, round(sqrt(abs(c_acctbal)), 6) AS q, mod(c_custkey, 7) AS m, sign(c_acctbal) AS s, sign(-c_nationkey) AS si FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_nationkey) AS ai, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS r, c_nationkey AS ri, sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS r1, pow(c_nationkey, 2) AS p, round(sqrt(abs(c_acctbal)), 6) AS q, c_custkey % 7 AS m, CAST(sign(c_acctbal) AS DOUBLE) AS s, CAST(sign(-c_nationkey) AS INT) AS si FROM customer")
dialect("null_all", "SELECT d.doc_id AS k, coalesce(l.quality, -1) AS c, ifnull(l.toxic, 9) AS i, nvl(NULL, d.lang) AS n, nullif(d.lang, 'en') AS u, isnull(l.quality) AS b, if(l.quality = 1, 'good', 'other') AS f, iff(d.n_chars > 100, 1, 0) AS g, typeof(l.quality) AS t, pg_typeof(d.text) AS y, to_char(d.doc_id) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id AS k, coalesce(l.quality, -1) AS c, coalesce(l.toxic, 9) AS i, d.lang AS n, nullif(d.lang, 'en') AS u, l.quality IS NULL AS b, CASE WHEN l.quality = 1 THEN 'good' ELSE 'other' END AS f, CASE WHEN d.n_chars > 100 THEN 1 ELSE 0 END AS g, CASE WHEN l.quality IS NULL THEN 'NULL' ELSE 'Int' END AS t, 'Text' AS y, CAST(d.doc_id AS VARCHAR) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
dialect("date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s FROM events")
dialect("date_diff", "SELECT o_orderkey, datediff(o_orderdate, CAST('1996-02-29' AS DATE)) AS n FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1996-02-29' AS INT) AS n FROM orders")
dialect("date_format_all", "SELECT event_id, date_format(ts, '%Y-%m-%d %H:%i:%s') AS a, date_format(ts, '%y/%c/%e %h %p') AS b, date_format(ts, '%M %b %W %a %j %w') AS c, date_format(ts, '%T|%r|%%|%q it''s') AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%y/%-m/%-d %I %p') AS b, strftime(ts, '%B %b %A %a %j %w') AS c, strftime(ts, '%H:%M:%S|%I:%M:%S %p|%%|') || '%q it''s' AS d FROM events")
dialect("str_to_date_all", "SELECT o_orderkey, str_to_date(date_format(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS d, str_to_date(date_format(o_orderdate, '%y-%c-%e') || ' 5:07:9', '%y-%m-%d %H:%i:%s') AS t, str_to_date('31-02-2024', '%d-%m-%Y') AS bad, str_to_date('2024-01-05 tail', '%Y-%m-%d') AS cut FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 HOUR + INTERVAL 7 MINUTE + INTERVAL 9 SECOND AS t, CAST(NULL AS DATE) AS bad, DATE '2024-01-05' AS cut FROM orders")
dialect("find_in_set", "SELECT c_custkey, find_in_set(c_mktsegment, 'building,Machinery,household') AS f FROM customer", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 0 END AS f FROM customer")
dialect("bin_base64", "SELECT n_nationkey, to_base64(n_name) AS e, encode(n_name, 'base64') AS e2, CAST(from_base64(to_base64(n_name)) AS TEXT) AS r, from_base64('***') IS NULL AS bad FROM nation", "SELECT n_nationkey, to_base64(encode(n_name)) AS e, to_base64(encode(n_name)) AS e2, n_name AS r, true AS bad FROM nation")
dialect("bin_hex", "SELECT n_nationkey, encode(n_name, 'hex') AS h, CAST(decode(encode(n_name, 'hex'), 'hex') AS TEXT) AS r, CAST(decode('0x4142', 'hex') AS TEXT) AS p FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, n_name AS r, 'AB' AS p FROM nation")
dialect("uuid_valid", "SELECT n_nationkey, is_valid_uuid(gen_random_uuid()) AS v4, is_uuid(uuid_generate_v7()) AS v7, substr(uuid7(), 15, 1) AS version7, is_valid_uuid(n_name) AS bad FROM nation", "SELECT n_nationkey, true AS v4, true AS v7, '7' AS version7, false AS bad FROM nation")
dialect("now_valid", "SELECT now() IS NOT NULL AS a, today() = CAST(now() AS DATE) AS b, unix_timestamp() > 1700000000 AS c, current_database() IS NOT NULL AS d, version() IS NOT NULL AS e", "SELECT true AS a, true AS b, true AS c, true AS d, true AS e")

# -- G: DML, DDL, constraints


def _copy(spark, sf_dir, name: str, columns: str, select: str) -> Session:
    session = Session(spark).attach(sf_dir, tuple(t for t in DRIVER_TABLES if re.search(rf"\b{t}\b", select)))
    session.execute(f"CREATE TABLE {name} ({columns})")
    session.execute(f"INSERT INTO {name} {select}")
    return session


def insert_values(spark, sf_dir):
    s = Session(spark)
    s.run("CREATE TABLE t (id INT NOT NULL, name TEXT, score DOUBLE); INSERT INTO t VALUES (1, 'a', 1.5), (2, NULL, -2.0); INSERT INTO t (id) VALUES (3)")
    return s.query("SELECT * FROM t")


def auto_increment(spark, sf_dir):
    s = Session(spark)
    s.run("CREATE TABLE t (id INT AUTO_INCREMENT, v TEXT); INSERT INTO t (v) VALUES ('a'), ('b'); INSERT INTO t VALUES (10, 'c'), (NULL, 'd'); INSERT INTO t (v) VALUES ('e')")
    return s.query("SELECT id, v = 'e' AS last FROM t")


def alter_add_drop_rename(spark, sf_dir):
    s = _copy(spark, sf_dir, "n", "k INT, name TEXT, r INT", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    s.run("ALTER TABLE n ADD COLUMN flag INT DEFAULT 7; ALTER TABLE n DROP COLUMN r; ALTER TABLE n RENAME COLUMN name TO label; ALTER TABLE n RENAME TO m")
    return s.query("SELECT * FROM m")


def _then(columns: str, select: str, *statements: str, name: str = "t"):
    def run(spark, sf_dir):
        s = _copy(spark, sf_dir, name, columns, select)
        for statement in statements:
            s.execute(statement)
        return s.query(f"SELECT * FROM {name}")

    return run


def _family(spark, sf_dir, action: str) -> Session:
    s = _copy(spark, sf_dir, "r", "rk INT PRIMARY KEY, name TEXT", "SELECT r_regionkey, r_name FROM region")
    s.attach(sf_dir, ("nation",))
    s.execute(f"CREATE TABLE n (nk INT PRIMARY KEY, rk INT REFERENCES r(rk) ON DELETE {action})")
    s.execute("INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation")
    s.execute("DELETE FROM r WHERE rk >= 3")
    return s


register("insert_values", insert_values, "SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE)), (2, NULL, -2.0), (3, NULL, NULL)) t(id, name, score)")
register("insert_select", _then("k BIGINT, b DOUBLE", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0"), "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal < 0")
register("auto_increment", auto_increment, "SELECT * FROM (VALUES (1, false), (2, false), (10, false), (3, false), (11, true)) t(id, last)")
register("update_where", _then("k BIGINT, seg TEXT, b DOUBLE", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", "UPDATE t SET b = b + 1000, seg = lower(seg) WHERE b < 0"), "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS b FROM customer")
register("delete_where", _then("k BIGINT, q INT", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "DELETE FROM t WHERE q = 1"), "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
register("truncate", _then("k INT", "SELECT r_regionkey FROM region", "TRUNCATE TABLE t", "INSERT INTO t VALUES (5)"), "SELECT 5 AS k")
register("alter_add_drop_rename", alter_add_drop_rename, "SELECT n_nationkey AS k, n_name AS label, 7 AS flag FROM nation")
register("constraint_not_null", lambda s, d: tb.not_null(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "quality"), ["quality"]), "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
register("constraint_unique", lambda s, d: tb.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
register("constraint_check", lambda s, d: tb.check_failures(table(s, d, "customer"), "c_acctbal >= 0").select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)")
register("fk_violations", lambda s, d: tb.orphans(table(s, d, "events").select("event_id", "user_id"), "user_id", table(s, d, "customer").filter("c_nationkey < 20"), "c_custkey"), "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
register("fk_cascade_delete", lambda s, d: _family(s, d, "CASCADE").query("SELECT nk, rk FROM n"), "SELECT n_nationkey AS nk, n_regionkey AS rk FROM nation WHERE n_regionkey < 3")
register("fk_set_null", lambda s, d: _family(s, d, "SET NULL").query("SELECT nk, rk FROM n"), "SELECT n_nationkey AS nk, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS rk FROM nation")
register("analyze_stats", lambda s, d: Session(s).attach(d, ("customer",)).execute("ANALYZE TABLE customer (c_custkey, c_nationkey, c_mktsegment)"), "SELECT 'c_custkey' AS column_name, count(*) AS row_count, count(DISTINCT c_custkey) AS ndv FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer")
register("show_columns", lambda s, d: Session(s).attach(d, ("nation",)).execute("SHOW COLUMNS FROM nation").select("field", "type"), "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(field, type)")
register("show_tables", lambda s, d: Session(s).attach(d, ("nation", "region")).execute("SHOW TABLES"), "SELECT * FROM (VALUES ('nation'), ('region')) t(table_name)")

# -- H: extensions

dialect("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
dialect("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
dialect("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
dialect("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
dialect("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_custkey, round(t, 2) AS t FROM big JOIN customer ON c_custkey = o_custkey WHERE t > 1000000")
dialect("window_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INT) AS r FROM customer")
register("window_frame", lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("moving")), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
dialect("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
dialect("cube", "SELECT p_brand, p_size > 25 AS large, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size > 25)")
dialect("count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
register("tumbling_window", lambda s, d: table(s, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v"), "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2")
register("session_window", lambda s, d: table(s, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n"), "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
