"""The test tables as a property graph.

Nodes: Region, Nation, Customer, Supplier, Part, Orders, Event, User.
Relationships: IN_REGION, LIVES_IN, LOCATED_IN, PLACED, CONTAINS, SUPPLIED,
NEXT_ORDER (consecutive orders of a customer) and FOLLOWED_BY (the user of the
next purchase, by event id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import GraphSession
from .types import GraphType

_KNOWN: dict[tuple[str, str], GraphSession] = {}


def load(spark: SparkSession, sf_dir: str) -> GraphSession:
    """The graph over one folder of tables; registrations are kept by folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = _build(spark, sf_dir)
    return _KNOWN[key]


def next_orders(orders: DataFrame) -> DataFrame:
    in_turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(in_turn).alias("dst")).where("dst is not null")


def followed_by(events: DataFrame) -> DataFrame:
    """The next purchase is found within ranges of event ids and over their
    borders, so that no task sorts all events."""
    spark = events.sparkSession
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = bought.agg(F.min("event_id"), F.max("event_id")).first()
    if low is None:
        return bought.select(F.col("user_id").alias("src"), F.col("user_id").alias("dst"))
    width = (high - low) // n + 1
    ranged = bought.withColumn("range", F.floor((F.col("event_id") - low) / width))
    in_range = Window.partitionBy("range").orderBy("event_id")
    last = ranged.withColumn("next", F.lead("user_id").over(in_range))
    # the first purchase of each range follows the last of the range before
    firsts = ranged.groupBy("range").agg(F.min(F.struct("event_id", "user_id")).alias("f"))
    order = Window.orderBy("range")  # one row a range
    heads = firsts.select(F.lag("range").over(order).alias("range"), F.col("f.user_id").alias("head"))
    joined = last.join(F.broadcast(heads), "range", "left")
    pairs = joined.select(F.col("user_id").alias("src"), F.coalesce("next", "head").alias("dst"))
    return pairs.where("dst is not null and src != dst").distinct()


def _build(spark: SparkSession, sf_dir: str) -> GraphSession:
    g = GraphSession(spark)
    t = {k: spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    for label, table, key in (
        ("Region", "region", "r_regionkey"),
        ("Nation", "nation", "n_nationkey"),
        ("Customer", "customer", "c_custkey"),
        ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"),
        ("Orders", "orders", "o_orderkey"),
        ("Event", "events", "event_id"),
    ):
        g.register_nodes(label, t[table], key)
    g.register_nodes("User", t["events"].select("user_id").distinct(), "user_id")
    rel = g.register_relationships
    rel("IN_REGION", t["nation"], "Nation", "Region", "n_nationkey", "n_regionkey", {}, whole=True)
    rel("LIVES_IN", t["customer"], "Customer", "Nation", "c_custkey", "c_nationkey", {}, whole=True)
    rel("LOCATED_IN", t["supplier"], "Supplier", "Nation", "s_suppkey", "s_nationkey", {}, whole=True)
    rel("PLACED", t["orders"], "Customer", "Orders", "o_custkey", "o_orderkey", {}, whole=True)
    line = {"l_linenumber": GraphType.INT64, "l_quantity": GraphType.FLOAT64, "l_extendedprice": GraphType.FLOAT64, "l_discount": GraphType.FLOAT64, "l_returnflag": GraphType.STRING}
    rel("CONTAINS", t["lineitem"], "Orders", "Part", "l_orderkey", "l_partkey", line, whole=True)
    rel("SUPPLIED", t["lineitem"], "Supplier", "Part", "l_suppkey", "l_partkey", {"l_quantity": GraphType.FLOAT64}, whole=True)
    rel("NEXT_ORDER", next_orders(t["orders"]), "Orders", "Orders", "src", "dst", {}, whole=True)
    rel("FOLLOWED_BY", followed_by(t["events"]), "User", "User", "src", "dst", {}, whole=True)
    return g
