"""The SQL surface: statements that run as they are, with the same text as their check."""

from __future__ import annotations

import re

from textrel.plans.engine import Engine
from textrel.queries import ORACLES, QUERIES
from textrel.session import table

#: Names of all tables a statement may use.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings player owner team city raw_chunks extraction_result row_provenance source_units demonyms chunk_limits extractor_trust mix_targets pack_specs".split()


def run(spark, folder: str, sql: str):
    """A statement answered by the engine over the tables it names, with join keys as they are."""
    named = {t: table(spark, folder, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    return Engine(spark, align_keys=False).load(named).query(sql).rows


STATEMENTS = {
    "sql_project": "SELECT p_partkey, part.p_name, p_brand FROM part",
    "sql_alias": "SELECT p.p_partkey AS part_id, p.p_size AS size FROM part p",
    "sql_filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
    "sql_filter_range": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_totalprice < 200000 AND o_orderstatus != 'F'",
    "sql_filter_le_gt": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10 AND p_retailprice > 950",
    "sql_filter_nested": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND (c_nationkey = 3 OR c_nationkey = 7 OR c_acctbal > 5000)",
    "sql_filter_not_null": "SELECT id, position FROM player WHERE position IS NOT NULL",
    "sql_text_range": "SELECT id, birth_date FROM player WHERE birth_date > '1990/01/01' AND birth_date <= '1999/12/31'",
    "sql_redundant": "SELECT id, age FROM player WHERE age >= 63 AND age = 63",
    "sql_contradiction": "SELECT id FROM player WHERE age = 30 AND age = 40",
    "sql_trailing_blanks": "SELECT id, nationality FROM player WHERE nationality = 'French  '",
    "sql_join2": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sql_join2_text": "SELECT player.id AS player_id, team.id AS team_id FROM player JOIN team ON player.team = team.team_name",
    "sql_join3": "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 300000",
    "sql_join4": "SELECT p.id AS player_id, t.id AS team_id, c.id AS city_id, o.id AS owner_id FROM player p JOIN team t ON p.team = t.team_name JOIN city c ON t.location = c.city_name JOIN owner o ON t.ownership = o.name",
    "sql_left_join": "SELECT t.id AS team_id, p.id AS player_id FROM team t LEFT JOIN player p ON t.team_name = p.team WHERE t.championship > 3 OR p.nba_championships < 1",
    "sql_join_reverse": "SELECT o.id AS owner_id, t.id AS team_id, p.id AS player_id FROM owner o JOIN team t ON o.nba_team = t.team_name JOIN player p ON p.team = t.team_name WHERE o.age > 60",
    "sql_right_join": "SELECT t.id AS team_id, o.id AS owner_id FROM team t RIGHT JOIN owner o ON t.ownership = o.name",
    "sql_full_join": "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) c ON s.s_nationkey = c.c_nationkey",
    "sql_join_using": "SELECT src, city.id, area_unit FROM city JOIN source_units USING (src)",
    "sql_semi_join": "SELECT t.id FROM team t WHERE EXISTS (SELECT 1 FROM player p WHERE p.team = t.team_name)",
    "sql_anti_join": "SELECT t.id FROM team t WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.nba_team = t.team_name)",
    "sql_count": "SELECT position, COUNT(*) AS n_rows, COUNT(college) AS n_colleges FROM player GROUP BY position",
    "sql_sum_avg_min_max": "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(CAST(AVG(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS DOUBLE) AS avg_qty, MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price FROM lineitem GROUP BY l_returnflag",
    "sql_many_aggregates": "SELECT nationality, MIN(age) AS min_age, MAX(age) AS max_age, SUM(mvp_awards) AS mvp, SUM(olympic_gold_medals) AS gold, COUNT(*) AS n FROM player WHERE mvp_awards < 7 OR olympic_gold_medals <= 3 GROUP BY nationality",
    "sql_two_keys": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "sql_filter_join_group": "SELECT n.n_name, COUNT(*) AS n_orders, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000 AND c.c_mktsegment = 'MACHINERY' GROUP BY n.n_name",
    "sql_four_tables_group": "SELECT r.r_name, s.s_nationkey, COUNT(*) AS n, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_discount > 0.05 GROUP BY r.r_name, s.s_nationkey",
    "sql_min_text": "SELECT draft_year, MIN(birth_date) AS first_birth, MIN(draft_pick) AS best_pick FROM player WHERE draft_pick < 30 GROUP BY draft_year",
    "sql_temporal_group": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "sql_having": "SELECT team, COUNT(*) AS n FROM player GROUP BY team HAVING COUNT(*) > 5",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "sql_union": "SELECT team AS name FROM player WHERE team IS NOT NULL UNION SELECT nba_team FROM owner WHERE nba_team IS NOT NULL",
    "sql_intersect": "SELECT team FROM player INTERSECT SELECT team_name FROM team",
    "sql_except": "SELECT team FROM player WHERE team IS NOT NULL EXCEPT SELECT team_name FROM team",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3",
    "sql_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
    "sql_cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM big GROUP BY n",
    "sql_case_in_like": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 15 THEN 'small' WHEN p_size IN (20, 30, 40) THEN 'round' ELSE 'other' END AS kind FROM part WHERE p_type LIKE '%DIU%'",
    "sql_distinct_aggregate": "SELECT user_id, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_source_prefix_counts": "SELECT split_part(doc_id, '/', 1) AS prefix, COUNT(*) AS n_chunks, COUNT(DISTINCT doc_id) AS n_docs FROM raw_chunks GROUP BY split_part(doc_id, '/', 1)",
    "sql_table_scan": "SELECT id, team_name, founded_year, location, ownership, championship FROM team",
    "sql_row_count": "SELECT COUNT(*) AS n FROM documents",
    "sql_distinct_values": "SELECT DISTINCT college FROM player WHERE college IS NOT NULL",
    "sql_per_table_filters": "SELECT p.id AS player_id, t.id AS team_id FROM player p JOIN team t ON p.team = t.team_name WHERE p.age > 40 AND t.founded_year < 1960 AND p.draft_pick <= 20",
}
for _name, _sql in STATEMENTS.items():
    QUERIES[_name] = lambda spark, folder, _sql=_sql: run(spark, folder, _sql)
    ORACLES[_name] = _sql


def _bare(name: str, sql: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, folder: run(spark, folder, sql)
    ORACLES[name] = oracle


# Statements with columns that are neither grouped nor aggregated.
_bare(
    "bare_columns",
    "SELECT nationality, position, COUNT(*) AS n FROM player WHERE age > 30 GROUP BY nationality",
    "SELECT nationality, min(position) AS position, COUNT(*) AS n FROM player WHERE age > 30 GROUP BY nationality",
)
_bare(
    "bare_columns_of_minimum",
    "SELECT o.o_custkey, o.o_orderkey, MIN(o.o_totalprice) AS lowest FROM orders o GROUP BY o.o_custkey",
    "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS o_orderkey, min(o_totalprice) AS lowest FROM orders GROUP BY o_custkey",
)
_bare(
    "bare_columns_of_maximum",
    "SELECT c_nationkey, c_name AS richest, MAX(c_acctbal) AS top FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, first(c_name ORDER BY c_acctbal DESC, c_name DESC) AS richest, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey",
)
_bare(
    "bare_columns_nested",
    "WITH best AS (SELECT o_custkey, o_orderkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT o_custkey, o_orderkey, top FROM best WHERE top > 400000 UNION ALL SELECT c_nationkey, c_custkey, MIN(c_acctbal) AS low FROM customer GROUP BY c_nationkey",
    "SELECT * FROM (SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) WHERE top > 400000 UNION ALL SELECT c_nationkey, first(c_custkey ORDER BY c_acctbal, c_custkey), min(c_acctbal) FROM customer GROUP BY c_nationkey",
)
