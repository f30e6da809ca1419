"""The graph engine's queries over the test tables, with their oracle SQL.

Sums and means of floating-point numbers are rounded on both sides, as engines
add in different orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testgraph
from .functions import expressions as ex
from .plans import logical as lp
from .session import CsvImportConfig, GraphSession
from .sources.files import shared_folder
from .types import GraphType

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str, sql: str, rounded: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = testgraph.load(spark, sf_dir).execute(text)
        return out.select(*[F.round(f"`{c}`", 2).alias(c) if c in rounded else F.col(f"`{c}`") for c in out.columns]) if rounded else out

    QUERIES[name], SQL[name] = run, sql


def built(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# scans, projections, filters
query("scan", "MATCH (r:Region) RETURN r.r_regionkey, r.r_name", 'SELECT CAST(r_regionkey AS BIGINT) AS "r.r_regionkey", r_name AS "r.r_name" FROM region')
query("project", "MATCH (n:Nation) RETURN n.n_name", 'SELECT n_name AS "n.n_name" FROM nation')
_C = 'SELECT c_custkey AS "c.c_custkey", c_acctbal AS "c.c_acctbal" FROM customer WHERE '
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"filter_{_name}", f"MATCH (c:Customer) WHERE c.c_nationkey {_op} 12 RETURN c.c_custkey, c.c_acctbal", f"{_C}c_nationkey {_op} 12")
query("filter_string", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_custkey, c.c_acctbal", f"{_C}c_mktsegment = 'BUILDING'")
query("filter_string_order", "MATCH (c:Customer) WHERE c.c_mktsegment < 'FURNITURE' RETURN c.c_custkey, c.c_acctbal", f"{_C}c_mktsegment < 'FURNITURE'")
query("filter_int_vs_float", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey, c.c_acctbal", f"{_C}c_acctbal > 5000")
query("filter_float_vs_int_column", "MATCH (c:Customer) WHERE c.c_nationkey >= 12.5 RETURN c.c_custkey, c.c_acctbal", f"{_C}c_nationkey >= 12.5")
query("filter_type_mismatch", "MATCH (c:Customer) WHERE c.c_name > 5 RETURN c.c_custkey, c.c_acctbal", f"{_C}false")
query("filter_type_mismatch_ne", "MATCH (c:Customer) WHERE c.c_name <> 5 RETURN c.c_custkey, c.c_acctbal", f"{_C}false")
query("inline_filter", "MATCH (c:Customer {c_mktsegment: 'MACHINERY'}) RETURN c.c_custkey, c.c_acctbal", f"{_C}c_mktsegment = 'MACHINERY'")
query("pk_lookup", "MATCH (o:Orders {o_orderkey: 77}) RETURN o.o_orderkey, o.o_totalprice", 'SELECT o_orderkey AS "o.o_orderkey", o_totalprice AS "o.o_totalprice" FROM orders WHERE o_orderkey = 77')
query("and_or_not", "MATCH (c:Customer) WHERE c.c_acctbal > 1000.0 AND (c.c_nationkey = 3 OR c.c_nationkey = 7) AND NOT c.c_mktsegment = 'BUILDING' RETURN c.c_custkey, c.c_acctbal", f"{_C}c_acctbal > 1000 AND c_nationkey IN (3, 7) AND NOT c_mktsegment = 'BUILDING'")
query("is_null", "MATCH (c:Customer) WHERE c.c_name IS NULL RETURN c.c_custkey, c.c_acctbal", f"{_C}c_name IS NULL")
query("is_not_null", "MATCH (c:Customer) WHERE c.c_name IS NOT NULL RETURN c.c_custkey, c.c_acctbal", f"{_C}c_name IS NOT NULL")
query("arithmetic", "MATCH (c:Customer) WHERE c.c_nationkey * 2 + 1 > 30 AND c.c_custkey % 3 = 1 AND c.c_custkey / 4 < 100 RETURN c.c_custkey, c.c_acctbal", f"{_C}c_nationkey * 2 + 1 > 30 AND c_custkey % 3 = 1 AND c_custkey // 4 < 100")
query("compare_properties", "MATCH (p:Part) WHERE p.p_retailprice > p.p_size RETURN p.p_partkey", 'SELECT p_partkey AS "p.p_partkey" FROM part WHERE p_retailprice > p_size')

# order, paging
query("order_by", "MATCH (n:Nation) RETURN n.n_name ORDER BY n.n_name DESC", 'SELECT n_name AS "n.n_name" FROM nation ORDER BY n_name DESC')
query("order_multi_key", "MATCH (c:Customer) RETURN c.c_custkey, c.c_nationkey ORDER BY c.c_nationkey DESC, c.c_custkey LIMIT 50", 'SELECT c_custkey AS "c.c_custkey", CAST(c_nationkey AS BIGINT) AS "c.c_nationkey" FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 50')
query("order_by_unreturned", "MATCH (c:Customer) RETURN c.c_name ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10", 'SELECT c_name AS "c.c_name" FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10')
query("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey ORDER BY c.c_custkey SKIP 20 LIMIT 30", 'SELECT c_custkey AS "c.c_custkey" FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20')
query("skip_only", "MATCH (n:Nation) RETURN n.n_nationkey ORDER BY n.n_nationkey SKIP 20", 'SELECT CAST(n_nationkey AS BIGINT) AS "n.n_nationkey" FROM nation ORDER BY n_nationkey OFFSET 20')
query("limit_insertion_order", "MATCH (c:Customer) RETURN c.c_custkey LIMIT 7", 'SELECT c_custkey AS "c.c_custkey" FROM customer ORDER BY c_custkey LIMIT 7')
query("negative_limit", "MATCH (n:Nation) RETURN n.n_name SKIP -3 LIMIT -1", 'SELECT n_name AS "n.n_name" FROM nation LIMIT 0')
query("topk", "MATCH (o:Orders) WHERE o.o_orderstatus = 'F' RETURN o.o_orderkey, o.o_totalprice ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10", "SELECT o_orderkey AS \"o.o_orderkey\", o_totalprice AS \"o.o_totalprice\" FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")

# aggregates
query("count_star", "MATCH (o:Orders) WHERE o.o_totalprice > 100000.0 RETURN COUNT(*)", 'SELECT count(*) AS "COUNT(*)" FROM orders WHERE o_totalprice > 100000')
query("count_col", "MATCH (c:Customer) RETURN COUNT(c.c_name)", 'SELECT count(c_name) AS "COUNT(c.c_name)" FROM customer')
query("count_distinct", "MATCH (o:Orders) RETURN COUNT(DISTINCT o.o_custkey)", 'SELECT count(DISTINCT o_custkey) AS "COUNT(DISTINCT o.o_custkey)" FROM orders')
query("sum_int", "MATCH (c:Customer) RETURN SUM(c.c_nationkey)", 'SELECT CAST(sum(c_nationkey) AS BIGINT) AS "SUM(c.c_nationkey)" FROM customer')
query("sum_float", "MATCH (c:Customer) RETURN SUM(c.c_acctbal)", 'SELECT round(sum(c_acctbal), 2) AS "SUM(c.c_acctbal)" FROM customer', ("SUM(c.c_acctbal)",))
query("avg", "MATCH (c:Customer) RETURN AVG(c.c_acctbal), AVG(c.c_nationkey)", 'SELECT round(avg(c_acctbal), 2) AS "AVG(c.c_acctbal)", round(avg(c_nationkey), 2) AS "AVG(c.c_nationkey)" FROM customer', ("AVG(c.c_acctbal)", "AVG(c.c_nationkey)"))
query("min_max", "MATCH (c:Customer) RETURN MIN(c.c_acctbal), MAX(c.c_acctbal), MIN(c.c_name), MAX(c.c_nationkey)", 'SELECT min(c_acctbal) AS "MIN(c.c_acctbal)", max(c_acctbal) AS "MAX(c.c_acctbal)", min(c_name) AS "MIN(c.c_name)", CAST(max(c_nationkey) AS BIGINT) AS "MAX(c.c_nationkey)" FROM customer')
query("agg_empty_input", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN COUNT(*), SUM(c.c_nationkey), SUM(c.c_acctbal), AVG(c.c_acctbal), MIN(c.c_name)", 'SELECT count(*) AS "COUNT(*)", CAST(coalesce(sum(c_nationkey), 0) AS BIGINT) AS "SUM(c.c_nationkey)", coalesce(sum(c_acctbal), 0.0) AS "SUM(c.c_acctbal)", avg(c_acctbal) AS "AVG(c.c_acctbal)", min(c_name) AS "MIN(c.c_name)" FROM customer WHERE c_custkey < 0')
query("group_by_implicit", "MATCH (c:Customer) RETURN c.c_mktsegment, COUNT(*), MIN(c.c_acctbal)", 'SELECT c_mktsegment AS "c.c_mktsegment", count(*) AS "COUNT(*)", min(c_acctbal) AS "MIN(c.c_acctbal)" FROM customer GROUP BY 1')
query("group_order_limit", "MATCH (o:Orders) RETURN o.o_custkey, COUNT(*) ORDER BY COUNT(*) DESC, o.o_custkey LIMIT 15", 'SELECT o_custkey AS "o.o_custkey", count(*) AS "COUNT(*)" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
query("return_distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment, c.c_nationkey", 'SELECT DISTINCT c_mktsegment AS "c.c_mktsegment", CAST(c_nationkey AS BIGINT) AS "c.c_nationkey" FROM customer')

# one relationship
query("rel_one_hop", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_custkey, n.n_name", 'SELECT c_custkey AS "c.c_custkey", n_name AS "n.n_name" FROM customer JOIN nation ON c_nationkey = n_nationkey')
_L = 'FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey'
query("rel_props", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity >= 49.0 RETURN o.o_orderkey, l.l_quantity, l.l_returnflag, p.p_name", f'SELECT o_orderkey AS "o.o_orderkey", l_quantity AS "l.l_quantity", l_returnflag AS "l.l_returnflag", p_name AS "p.p_name" {_L} WHERE l_quantity >= 49')
query("rel_filter_src", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE o.o_totalprice > 400000.0 RETURN o.o_orderkey, p.p_partkey", f'SELECT o_orderkey AS "o.o_orderkey", p_partkey AS "p.p_partkey" {_L} WHERE o_totalprice > 400000')
query("rel_filter_dst", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE p.p_size = 50 RETURN o.o_orderkey, p.p_partkey", f'SELECT o_orderkey AS "o.o_orderkey", p_partkey AS "p.p_partkey" {_L} WHERE p_size = 50')
query("rel_inline_filter", "MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation {n_nationkey: 4}) RETURN s.s_name", 'SELECT s_name AS "s.s_name" FROM supplier WHERE s_nationkey = 4')
query("rel_inline_both", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:LIVES_IN]->(n:Nation {n_regionkey: 2}) RETURN c.c_custkey, n.n_nationkey", "SELECT c_custkey AS \"c.c_custkey\", CAST(n_nationkey AS BIGINT) AS \"n.n_nationkey\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 2")
query("rel_agg", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name, COUNT(*), SUM(c.c_acctbal)", 'SELECT n_name AS "n.n_name", count(*) AS "COUNT(*)", round(sum(c_acctbal), 2) AS "SUM(c.c_acctbal)" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1', ("SUM(c.c_acctbal)",))
query("rel_count_only", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) RETURN COUNT(*)", 'SELECT count(*) AS "COUNT(*)" FROM lineitem')
query("rel_edge_agg", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) RETURN l.l_returnflag, COUNT(*), SUM(l.l_quantity)", 'SELECT l_returnflag AS "l.l_returnflag", count(*) AS "COUNT(*)", round(sum(l_quantity), 2) AS "SUM(l.l_quantity)" FROM lineitem GROUP BY 1', ("SUM(l.l_quantity)",))
query("rel_backward", "MATCH (n:Nation)<-[:LOCATED_IN]-(s:Supplier) RETURN n.n_name, s.s_suppkey", 'SELECT n_name AS "n.n_name", s_suppkey AS "s.s_suppkey" FROM supplier JOIN nation ON s_nationkey = n_nationkey')
query("rel_parallel_edges", "MATCH (s:Supplier)-[x:SUPPLIED]->(p:Part) RETURN s.s_suppkey, p.p_partkey, COUNT(*)", 'SELECT l_suppkey AS "s.s_suppkey", l_partkey AS "p.p_partkey", count(*) AS "COUNT(*)" FROM lineitem GROUP BY 1, 2')
query("rel_order_limit", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_name, o.o_orderkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10", 'SELECT c_name AS "c.c_name", o_orderkey AS "o.o_orderkey" FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10')

# paths
_F = """WITH b AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT user_id AS s, nxt AS d FROM (SELECT user_id, lead(user_id) OVER (ORDER BY event_id) AS nxt FROM b) WHERE nxt IS NOT NULL AND nxt <> user_id)"""
_N = """WITH e AS (SELECT s, d FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL)"""
query("rel_both", "MATCH (a:User)-[:FOLLOWED_BY]-(b:User) RETURN a.user_id, b.user_id", f'{_F} SELECT s AS "a.user_id", d AS "b.user_id" FROM e UNION ALL SELECT d, s FROM e')
query("path_2_2", "MATCH (a:Orders)-[:NEXT_ORDER*2..2]->(b:Orders) RETURN a.o_orderkey, b.o_orderkey", f'{_N} SELECT x.s AS "a.o_orderkey", y.d AS "b.o_orderkey" FROM e x JOIN e y ON x.d = y.s')
query("path_1_3", "MATCH (a:Orders)-[r:NEXT_ORDER*1..3]->(b:Orders) RETURN r.length, COUNT(*)", f'{_N} SELECT * FROM (SELECT CAST(1 AS BIGINT) AS "r.length", count(*) AS "COUNT(*)" FROM e UNION ALL SELECT 2, count(*) FROM e x JOIN e y ON x.d = y.s UNION ALL SELECT 3, count(*) FROM e x JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s)')
query("path_nodes", "MATCH (a:Orders)-[r:NEXT_ORDER*1..2]->(b:Orders) RETURN r.path, r.length", f"{_N} SELECT s || '->' || d AS \"r.path\", CAST(1 AS BIGINT) AS \"r.length\" FROM e UNION ALL SELECT x.s || '->' || y.s || '->' || y.d, 2 FROM e x JOIN e y ON x.d = y.s")
query("path_3_cyclic", "MATCH (a:User)-[r:FOLLOWED_BY*1..3]->(b:User) RETURN r.length, COUNT(*)", f'{_F} SELECT * FROM (SELECT CAST(1 AS BIGINT) AS "r.length", count(*) AS "COUNT(*)" FROM e UNION ALL SELECT 2, count(*) FROM e x JOIN e y ON x.d = y.s WHERE y.d <> x.s UNION ALL SELECT 3, count(*) FROM e x JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s WHERE y.d <> x.s AND z.d <> x.s AND z.d <> x.d)')
query("path_cyclic", "MATCH (a:User)-[:FOLLOWED_BY*1..2]->(b:User) RETURN a.user_id, b.user_id", f'{_F} SELECT s AS "a.user_id", d AS "b.user_id" FROM e UNION ALL SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s WHERE x.s <> y.d')
query("path_dst_filter", "MATCH (a:Orders)-[:NEXT_ORDER*1..2]->(b:Orders) WHERE b.o_totalprice > 400000.0 RETURN a.o_orderkey, b.o_orderkey", f'{_N}, p AS (SELECT s, d FROM e UNION ALL SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s) SELECT s AS "a.o_orderkey", d AS "b.o_orderkey" FROM p JOIN orders ON d = o_orderkey WHERE o_totalprice > 400000')
query("path_src_filter", "MATCH (a:Orders)-[:NEXT_ORDER*2..3]->(b:Orders) WHERE a.o_orderstatus = 'F' AND a.o_totalprice > 300000.0 RETURN a.o_orderkey, b.o_orderkey", f"{_N}, p AS (SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s UNION ALL SELECT x.s, z.d FROM e x JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s) SELECT s AS \"a.o_orderkey\", d AS \"b.o_orderkey\" FROM p JOIN orders ON s = o_orderkey WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
query("path_heterogeneous", "MATCH (c:Customer)-[:LIVES_IN*1..3]->(n:Nation) RETURN c.c_custkey, n.n_nationkey", 'SELECT c_custkey AS "c.c_custkey", CAST(c_nationkey AS BIGINT) AS "n.n_nationkey" FROM customer')

# sets and joins of plans
query("union_all", "MATCH (c:Customer) WHERE c.c_nationkey < 5 RETURN c.c_nationkey UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey", 'SELECT CAST(c_nationkey AS BIGINT) AS "c.c_nationkey" FROM customer WHERE c_nationkey < 5 UNION ALL SELECT s_nationkey FROM supplier')
query("union_distinct", "MATCH (c:Customer) WHERE c.c_nationkey < 5 RETURN c.c_nationkey UNION MATCH (s:Supplier) RETURN s.s_nationkey", 'SELECT CAST(c_nationkey AS BIGINT) AS "c.c_nationkey" FROM customer WHERE c_nationkey < 5 UNION SELECT s_nationkey FROM supplier')


def _joined(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = testgraph.load(spark, sf_dir)
        rich = lp.NodeScan(g.catalog.node("Customer"), "c", (ex.Compare(">", ex.Property("c", "c_acctbal", GraphType.FLOAT64), ex.Literal(5000)),), ("c_custkey", "c_nationkey"))
        some = lp.NodeScan(g.catalog.node("Nation"), "n", (ex.Compare("<", ex.Property("n", "n_nationkey", GraphType.INT64), ex.Literal(20)),), ("n_nationkey", "n_name"))
        plan = lp.HashJoin(rich, some, ("c.c_nationkey",), ("n.n_nationkey",), kind)
        items = tuple((k, ex.Property(*k.split("."), plan.schema[k])) for k in ("c.c_custkey", "n.n_name"))
        return lp.Project(plan, items).frame(g)

    return run


for _kind in ("inner", "left", "right", "full"):
    built(f"hash_join_{_kind}", f'SELECT c_custkey AS "c.c_custkey", n_name AS "n.n_name" FROM (SELECT * FROM customer WHERE c_acctbal > 5000) {_kind} JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey')(_joined(_kind))


@built("rel_scan", "SELECT l_orderkey AS \"e._src\", l_partkey AS \"e._dst\", l_quantity AS \"e.l_quantity\" FROM lineitem WHERE l_returnflag = 'R'")
def rel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = testgraph.load(spark, sf_dir)
    plan = lp.RelScan(g.catalog.rel("CONTAINS"), "e")
    wanted = lp.Filter(plan, ex.Compare("=", ex.Property("e", "l_returnflag", GraphType.STRING), ex.Literal("R")))
    return wanted.frame(g).select("`e._src`", "`e._dst`", "`e.l_quantity`")


@built("empty_plan", 'SELECT c_custkey AS "c.c_custkey" FROM customer WHERE false')
def empty_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.Empty({"c.c_custkey": GraphType.INT64}).frame(testgraph.load(spark, sf_dir))


@built("explain", "SELECT 'NodeScan: Customer as c' || chr(10) || '  Extend: LIVES_IN (c -> n)' || chr(10) || '    Filter: predicate' || chr(10) || '    Project: [n.n_name, Count(*)]' || chr(10) AS plan")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testgraph.load(spark, sf_dir).execute("EXPLAIN MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_acctbal > 0.0 RETURN n.n_name, COUNT(*)")


# statements and imports
def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodegraph-{uuid.uuid4().hex[:12]}"


@built("create_and_match", """SELECT * FROM (VALUES ('Alice', CAST(25.5 AS DOUBLE), true), ('Bob', 30.0, false)) t("p.name", "p.score", "p.active")""")
def create_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.execute("CREATE NODE TABLE Person(name STRING, score FLOAT64, active BOOL, PRIMARY KEY(name))")
    g.execute("CREATE (:Person {name: 'Alice', score: 25.5, active: TRUE})")
    g.execute("CREATE (:Person {name: 'Bob', score: 30, active: FALSE})")
    return g.execute("MATCH (p:Person) RETURN p.name, p.score, p.active")


def _people(g: GraphSession) -> None:
    g.execute("CREATE NODE TABLE Person(name STRING, age INT64, PRIMARY KEY(name))")
    g.execute("CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    for name, age in (("Alice", 25), ("Bob", 35), ("Charlie", 45)):
        g.execute(f"CREATE (:Person {{name: '{name}', age: {age}}})")
    g.execute("MATCH (a:Person {name: 'Alice'}), (b:Person {name: 'Bob'}) CREATE (a)-[:KNOWS {since: 2020}]->(b)")
    g.execute("MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Charlie'}) CREATE (b)-[:KNOWS {since: 2021}]->(a)")
    g.execute("MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Nobody'}) CREATE (a)-[:KNOWS {since: 2022}]->(b)")


_KNOWS = """SELECT * FROM (VALUES ('Alice', 'Bob', CAST(2020 AS BIGINT)), ('Charlie', 'Bob', 2021)) t("a.name", "b.name", "k.since")"""


@built("match_create", _KNOWS)
def match_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    _people(g)
    return g.execute("MATCH (a:Person)-[k:KNOWS]->(b:Person) RETURN a.name, b.name, k.since")


@built("persist_and_reopen", _KNOWS)
def persist_and_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    with GraphSession.open(spark, path) as g:
        _people(g)
    return GraphSession.open(spark, path, read_only=True).execute("MATCH (a:Person)-[k:KNOWS]->(b:Person) RETURN a.name, b.name, k.since")


def _csv(frame: DataFrame, spark: SparkSession) -> str:
    path = f"{_folder(spark)}.csv"
    frame.write.option("header", True).csv(path)
    return path


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


_CUSTOMER = "CREATE NODE TABLE Customer(c_custkey INT64, c_name STRING, c_acctbal FLOAT64, c_mktsegment STRING, PRIMARY KEY(c_custkey))"


@built("csv_nodes", 'SELECT c_custkey AS "c.c_custkey", c_name AS "c.c_name", c_acctbal AS "c.c_acctbal" FROM customer')
def csv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.execute(_CUSTOMER)
    g.execute(f"COPY Customer FROM '{_csv(_customers(spark, sf_dir), spark)}'")
    return g.execute("MATCH (c:Customer) RETURN c.c_custkey, c.c_name, c.c_acctbal")


@built("csv_ignore_errors", "SELECT count(*) - sum(CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS rows_imported, sum(CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS rows_failed FROM customer")
def csv_ignore_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.execute(_CUSTOMER)
    spoilt = _customers(spark, sf_dir).withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")))
    return g.execute(f"COPY Customer FROM '{_csv(spoilt, spark)}' (HEADER = TRUE, IGNORE_ERRORS = TRUE)")


@built("csv_rels", 'SELECT c_name AS "c.c_name", o_orderkey AS "o.o_orderkey", p.price AS "r.price" FROM (SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders) p JOIN customer ON o_custkey = c_custkey')
def csv_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g.execute(_CUSTOMER)
    g.execute("CREATE NODE TABLE Orders(o_orderkey INT64, PRIMARY KEY(o_orderkey))")
    g.execute("CREATE REL TABLE PLACED(FROM Customer TO Orders, price FLOAT64)")
    g.import_nodes("Customer", _csv(_customers(spark, sf_dir), spark))
    g.import_nodes("Orders", _csv(orders.select("o_orderkey"), spark), CsvImportConfig(ignore_errors=True))
    g.import_relationships("PLACED", _csv(orders.select(F.col("o_custkey").alias("FROM"), F.col("o_orderkey").alias("TO"), F.col("o_totalprice").alias("price")), spark))
    return g.execute("MATCH (c:Customer)-[r:PLACED]->(o:Orders) RETURN c.c_name, o.o_orderkey, r.price")


# CSV rules, over the whole customer table
def _lines(frame: DataFrame, *columns, header: str | None = None, delimiter: str = ",") -> str:
    """One file of lines in the order of the key, written as they are."""
    path = f"{_folder(frame.sparkSession)}.csv"
    line = F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    rows = frame.select(F.lit(1).alias("part"), "c_custkey", line.alias("value"))
    if header:
        rows = frame.sparkSession.createDataFrame([(0, 0, header)], "part int, c_custkey long, value string").union(rows)
    rows.coalesce(1).sortWithinPartitions("part", "c_custkey").select("value").write.text(path)
    return path


def _c(name: str):
    return F.col(f"c_{name}")


def _fresh(spark: SparkSession, columns: str) -> GraphSession:
    g = GraphSession(spark)
    g.execute(f"CREATE NODE TABLE P({columns}, PRIMARY KEY(id))")
    return g


@built("csv_delimiter_skip_no_header", 'SELECT c_custkey AS "p.id", c_name AS "p.name" FROM customer ORDER BY c_custkey OFFSET 3')
def csv_delimiter_skip_no_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _fresh(spark, "id INT64, name STRING")
    path = _lines(_customers(spark, sf_dir), _c("custkey"), _c("name"), delimiter=";")
    g.execute(f"COPY P FROM '{path}' (HEADER=FALSE, DELIM=';', SKIP=3)")
    return g.execute("MATCH (p:P) RETURN p.id, p.name")


@built("csv_quoted_fields", """SELECT c_custkey AS "p.id", c_name || chr(10) || 'said "yes", and left ' AS "p.name" FROM customer""")
def csv_quoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks, delimiters, doubled quotes and blanks inside quotes."""
    g = _fresh(spark, "id INT64, name STRING")
    quoted = F.concat(F.lit('"'), _c("name"), F.lit('\nsaid ""yes"", and left "'))
    g.import_nodes("P", _lines(_customers(spark, sf_dir), quoted, _c("custkey"), header="name,id"))
    return g.execute("MATCH (p:P) RETURN p.id, p.name")


@built("csv_whitespace_and_empty", """SELECT c_custkey AS "p.id", CASE WHEN c_custkey % 3 > 0 THEN ' ' || c_name || ' ' END AS "p.name", CASE WHEN c_custkey % 2 = 1 THEN CAST(c_nationkey AS BIGINT) END AS "p.n" FROM customer""")
def csv_whitespace_and_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space is part of a field; an empty one is null."""
    g = _fresh(spark, "id INT64, name STRING, n INT64")
    name = F.when(_c("custkey") % 3 > 0, F.concat(F.lit(" "), _c("name"), F.lit(" ")))
    g.import_nodes("P", _lines(_customers(spark, sf_dir), _c("custkey"), name, F.when(_c("custkey") % 2 == 1, _c("nationkey")), header="id,name,n"))
    return g.execute("MATCH (p:P) RETURN p.id, p.name, p.n")


@built("csv_ragged_rows", """SELECT c_custkey AS "p.id", CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS "p.segment" FROM customer""")
def csv_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With IGNORE_ERRORS short rows end in nulls and long ones lose their ends."""
    g = _fresh(spark, "id INT64, segment STRING")
    line = F.when(_c("custkey") % 4 == 1, _c("custkey").cast("string")).when(_c("custkey") % 4 == 2, F.concat_ws(",", _c("custkey"), _c("mktsegment"), F.lit("more"))).otherwise(F.concat_ws(",", _c("custkey"), _c("mktsegment")))
    g.import_nodes("P", _lines(_customers(spark, sf_dir), line, header="id,segment"), CsvImportConfig(ignore_errors=True))
    return g.execute("MATCH (p:P) RETURN p.id, p.segment")


def _spelt():
    return F.element_at(F.array(*map(F.lit, ("true", "FALSE", "True", "1", "yes", "f"))), (_c("custkey") % 6 + 1).cast("int"))


@built("csv_booleans", 'SELECT c_custkey AS "p.id", c_custkey % 6 <> 1 AS "p.ok" FROM customer WHERE c_custkey % 6 < 3')
def csv_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes take true and false, in any case, only."""
    g = _fresh(spark, "id INT64, ok BOOL")
    g.import_nodes("P", _lines(_customers(spark, sf_dir), _c("custkey"), _spelt(), header="id,ok"), CsvImportConfig(ignore_errors=True))
    return g.execute("MATCH (p:P) RETURN p.id, p.ok")


@built("csv_rel_booleans", 'SELECT c_custkey AS "a.id", c_custkey % 6 NOT IN (1, 5) AS "k.ok" FROM customer')
def csv_rel_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships take 1, yes, t and their opposites too."""
    g, customers = _fresh(spark, "id INT64"), _customers(spark, sf_dir)
    g.execute("CREATE REL TABLE K(FROM P TO P, ok BOOL)")
    g.import_nodes("P", _lines(customers, _c("custkey"), header="id"))
    g.import_relationships("K", _lines(customers, _c("custkey"), _c("custkey"), _spelt(), header="from,To,ok"))
    return g.execute("MATCH (a:P)-[k:K]->(b:P) RETURN a.id, k.ok")


_AT = "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) + 1 AS r FROM customer"


@built("csv_bad_rows", f"SELECT r AS row, CASE k % 5 WHEN 2 THEN 'column ''n'': Invalid INT64: 1.5' WHEN 3 THEN 'column ''x'': Invalid FLOAT64: NaN' ELSE 'column ''n'': Invalid INT64: 7 ' END AS reason FROM ({_AT}) WHERE k % 5 IN (2, 3, 4)")
def csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and reasons of all bad rows, counted from 1 with the header."""
    g = _fresh(spark, "id INT64, n INT64, x FLOAT64")
    k = _c("custkey") % 5
    n = F.when(k == 2, "1.5").when(k == 4, "7 ").otherwise("12")
    got = g.import_nodes("P", _lines(_customers(spark, sf_dir), _c("custkey"), n, F.when(k == 3, "NaN").otherwise("2.5"), header="id,n,x"), CsvImportConfig(ignore_errors=True))
    return got.bad_rows


@built("csv_rel_keys", f"SELECT r AS row, CASE k % 4 WHEN 1 THEN 'FROM key cannot be empty' WHEN 2 THEN 'TO key cannot be empty' ELSE 'Destination node with key ' || chr(39) || '-' || k || chr(39) || ' not found' END AS reason FROM ({_AT}) WHERE k % 4 > 0")
def csv_rel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and unknown keys of relationships."""
    g, customers = _fresh(spark, "id INT64"), _customers(spark, sf_dir)
    g.execute("CREATE REL TABLE K(FROM P TO P)")
    g.import_nodes("P", _lines(customers, _c("custkey"), header="id"))
    k = _c("custkey") % 4
    to = F.when(k == 2, "").when(k == 3, F.concat(F.lit("-"), _c("custkey").cast("string"))).otherwise(_c("custkey").cast("string"))
    got = g.import_relationships("K", _lines(customers, F.when(k != 1, _c("custkey")), to, header="FROM,TO"), CsvImportConfig(ignore_errors=True))
    return got.bad_rows


@built("csv_result", "SELECT count(*) AS imported, CAST(0 AS BIGINT) AS failed, CAST(sum(octet_length(encode(c_custkey || ',' || c_name || chr(10)))) + 8 AS BIGINT) AS bytes, true AS told FROM customer")
def csv_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and bytes of an import, and what its callback is told."""
    g, told = _fresh(spark, "id INT64, name STRING"), []
    got = g.import_nodes("P", _lines(_customers(spark, sf_dir), _c("custkey"), _c("name"), header="id,name"), progress=told.append)
    right = told[0].bytes_read == 0 and told[-1].percent == 100.0 and told[-1].rows_processed == got.rows_imported and all(a.bytes_read <= b.bytes_read for a, b in zip(told, told[1:]))
    return spark.createDataFrame([(got.rows_imported, got.rows_failed, got.bytes_processed, right)], "imported long, failed long, bytes long, told boolean")


@built("stream_import", 'SELECT c_custkey AS "p.id", c_name AS "p.name" FROM customer')
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a folder, taken in by a stream that ends when all are."""
    from .streaming.ingest import stream_nodes

    g = _fresh(spark, "id INT64, name STRING")
    files = f"{_folder(spark)}.csv"
    _customers(spark, sf_dir).select("c_custkey", "c_name").repartition(3).write.option("header", True).csv(files)
    stream_nodes(g, "P", files, _folder(spark), available_now=True, max_files=2).awaitTermination()
    return g.execute("MATCH (p:P) RETURN p.id, p.name")


@built("create_many", 'SELECT c_custkey AS "p.id", c_acctbal AS "p.x" FROM customer')
def create_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _fresh(spark, "id INT64, x FLOAT64")
    g.create_nodes("P", _customers(spark, sf_dir).selectExpr("c_custkey as id", "c_acctbal as x"))
    return g.execute("MATCH (p:P) RETURN p.id, p.x")


@built("planner_rules", "SELECT unnest(['FilterPushdown', 'ProjectionPushdown']) AS rule, unnest([1, 2]) AS place, unnest(['NodeScan: Customer as c', 'Project: [c.c_name]']) AS holds")
def planner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that change a plan, and lines of the verbose explanation."""
    g = testgraph.load(spark, sf_dir)
    q = "MATCH (c:Customer) WHERE c.c_acctbal > 5000.0 RETURN c.c_name"
    text = g.explain(q, verbose=True)
    rules = text.split("Rules applied: ")[1].split("\n")[0].split(", ")
    held = [w if w in text else "" for w in ("NodeScan: Customer as c", "Project: [c.c_name]")]
    return spark.createDataFrame([(r, k + 1, h) for k, (r, h) in enumerate(zip(rules, held))], "rule string, place int, holds string")


# NaN, which compares to nothing: on each side, with every operator, and under NOT
def _with_nan(spark: SparkSession, sf_dir: str) -> GraphSession:
    g = GraphSession(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    third = F.col("p_partkey") % 3
    x = F.when(third == 0, F.lit(float("nan"))).when(third == 1, F.col("p_size").cast("double") + F.col("p_partkey") % 5 - 2)
    g.register_nodes("X", part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("n"), x.alias("x"), F.when(F.col("p_partkey") % 2 == 0, x).otherwise(25.0).alias("y")), "id")
    return g


_X = "SELECT p_partkey AS \"a.id\" FROM (SELECT p_partkey, p_size AS n, CASE WHEN p_partkey % 3 = 1 THEN p_size + p_partkey % 5 - 2 END AS x, p_partkey % 2 AS odd FROM part)"
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    for _side, _text, _sql in (
        ("left", f"a.x {_op} a.n", f"x {_op} n"),
        ("right", f"a.n {_op} a.x", f"n {_op} x"),
        ("literal", f"a.x {_op} 25.0", f"x {_op} 25"),
        ("literal_left", f"25 {_op} a.x", f"25 {_op} x"),
        ("both", f"a.x {_op} a.y", f"x {_op} (CASE WHEN odd = 0 THEN x ELSE 25 END)"),
        ("not", f"NOT a.x {_op} a.n", f"NOT x {_op} n"),
        ("not_literal", f"NOT (a.x {_op} 25.0 OR a.n {_op} a.x)", f"NOT (x {_op} 25 OR n {_op} x)"),
    ):
        built(f"nan_{_side}_{_name}", f"{_X} WHERE {_sql}")(lambda spark, sf_dir, w=_text: _with_nan(spark, sf_dir).execute(f"MATCH (a:X) WHERE {w} RETURN a.id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue-like roll-up over a two-table pattern."""
    return testgraph.load(spark, sf_dir).execute(
        "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 25.0 AND p.p_size > 10 RETURN p.p_brand, COUNT(*), AVG(l.l_extendedprice) ORDER BY COUNT(*) DESC, p.p_brand"
    )


__all__ = ["QUERIES", "SQL", "flagship"]
