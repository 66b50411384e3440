"""Trees over the sample tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TreeFrame, from_nodes
from ..sources.hierarchy import from_edges
from ..storage import packed

_TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ATTRIBUTES = {"Customer": ["cents"], "Order": ["cents", "status"], "Lineitem": ["cents", "quantity", "status"]}
_KINDS = {"cents": T.LongType(), "quantity": T.LongType(), "status": T.StringType()}
_kept: dict[tuple, TreeFrame] = {}


def _catalog(symbols: list[str]) -> dict:
    return {s: {a: _KINDS[a] for a in _ATTRIBUTES.get(s, [])} for s in symbols}


def sales_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene / Region / Nation / Customer / first Order < next Order ..., Lineitem + its Order."""

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def rows(df, base, key, parent, link, symbol, scale, cents=None, quantity=None, status=None, number=None, place=None):
        null = F.lit(None)
        return df.select(
            (F.lit(base).cast("bigint") + F.col(key)).alias("node_id"),
            parent.cast("bigint").alias("parent_id"),
            link.alias("link"),
            F.lit(symbol).alias("symbol"),
            (F.col(key) if number is None else F.col(number)).cast("int").alias("index"),
            F.lit(scale).alias("scale"),
            (null if cents is None else F.round(F.col(cents) * 100)).cast("bigint").alias("cents"),
            (null if quantity is None else F.col(quantity)).cast("bigint").alias("quantity"),
            (null if status is None else F.col(status)).cast("string").alias("status"),
            *([] if place is None else [place.alias("child_ord")]),
        )

    slash, million = F.lit("/"), 10**12
    scene = spark.range(1).withColumnRenamed("id", "k")
    orders = table("orders").withColumn("_before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    lines = table("lineitem").withColumn("_rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_TIE)))
    # an order is the first child of its customer or of the order before, as its id is less than those of lines; a second root comes after the scene
    after = orders.where("_before is not null").groupBy(F.col("_before").alias("l_orderkey")).agg(F.count(F.lit(1)).cast("int").alias("_after"))
    lines = lines.join(after, "l_orderkey", "left").withColumn("_place", F.col("_rn") + F.coalesce("_after", F.lit(0)))
    lines = lines.withColumn("_key", F.col("l_orderkey") * 100 + F.col("_rn"))
    first = F.col("_before").isNull()
    order = F.when(first & F.col("o_custkey").isNull(), 2).otherwise(1)
    few = (
        rows(scene, 1, "k", F.lit(None), slash, "Scene", 0)
        .union(rows(table("region"), million, "r_regionkey", F.lit(1), slash, "Region", 1))
        .union(rows(table("nation"), 2 * million, "n_nationkey", million + F.col("n_regionkey"), slash, "Nation", 2))
        .union(rows(table("customer"), 3 * million, "c_custkey", 2 * million + F.col("c_nationkey"), slash, "Customer", 3, "c_acctbal"))
    )
    return (
        few.withColumn("child_ord", F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id")))
        .union(rows(orders, 4 * million, "o_orderkey", F.when(first, 3 * million + F.col("o_custkey")).otherwise(4 * million + F.col("_before")), F.when(first, "/").otherwise("<"), "Order", 4, "o_totalprice", None, "o_orderstatus", None, order))
        .union(rows(lines, 5 * million, "_key", 4 * million + F.col("l_orderkey"), F.lit("+"), "Lineitem", 5, "l_extendedprice", "l_quantity", "l_returnflag", "_rn", F.col("_place")))
    )


def _keep(spark: SparkSession, name: str, sf_dir: str, make) -> TreeFrame:
    """The tree, stored once per session and folder; its index is built when a query first needs it, and then kept with it."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept:
        tree = make()
        _kept[key] = tree.with_nodes(packed(tree.nodes, name))
    return _kept[key]


def sales_tree(spark: SparkSession, sf_dir: str) -> TreeFrame:
    symbols = ["Scene", "Region", "Nation", "Customer", "Order", "Lineitem"]
    header = {"symbols": symbols, "scales": list(range(6))}
    return _keep(spark, "sales", sf_dir, lambda: from_nodes(sales_nodes(spark, sf_dir), _catalog(symbols), header))


def event_trees(spark: SparkSession, sf_dir: str) -> TreeFrame:
    """One tree per user: User / first event < next event ..., by time: long chains in many trees."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    users = events.select("user_id").distinct().select(F.col("user_id").cast("string").alias("tree_id"), F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("/").alias("link"), F.lit("User").alias("symbol"), F.lit(None).cast("int").alias("index"), F.lit(0).alias("scale"), F.lit(None).cast("bigint").alias("cents"))
    chain = events.select(F.col("user_id").cast("string").alias("tree_id"), (F.col("event_id") + 1).alias("node_id"), F.coalesce(before + 1, F.lit(0)).alias("parent_id"), F.when(before.isNull(), "/").otherwise("<").alias("link"), F.col("event_type").alias("symbol"), F.lit(None).cast("int").alias("index"), F.lit(1).alias("scale"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return _keep(spark, "events", sf_dir, lambda: from_nodes(users.union(chain), header={}))


def conversation_trees(spark: SparkSession, sf_dir: str) -> TreeFrame:
    """One tree per conversation: first turn < next turn ..."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select("conv_id", "turn", before.alias("before"), "role", F.lit(1).alias("scale"), F.when(before.isNull(), "/").otherwise("<").alias("link"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))
    return _keep(spark, "conversations", sf_dir, lambda: from_edges(rows, "turn", "before", symbol="role", tree="conv_id"))


_T = 10**12
SALES_SQL = f"""
ord AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_TIE)}) AS rn FROM lineitem),
raw AS (
 SELECT 1::BIGINT AS node_id, NULL::BIGINT AS parent_id, '/' AS link, 'Scene' AS symbol, 0::BIGINT AS idx, 0 AS scale, NULL::BIGINT AS cents, NULL::BIGINT AS quantity, NULL::VARCHAR AS status
 UNION ALL SELECT {_T}+r_regionkey, 1, '/', 'Region', r_regionkey, 1, NULL, NULL, NULL FROM region
 UNION ALL SELECT {2 * _T}+n_nationkey, {_T}+n_regionkey, '/', 'Nation', n_nationkey, 2, NULL, NULL, NULL FROM nation
 UNION ALL SELECT {3 * _T}+c_custkey, {2 * _T}+c_nationkey, '/', 'Customer', c_custkey, 3, round(c_acctbal*100)::BIGINT, NULL, NULL FROM customer
 UNION ALL SELECT {4 * _T}+o_orderkey, CASE WHEN prev IS NULL THEN {3 * _T}+o_custkey ELSE {4 * _T}+prev END, CASE WHEN prev IS NULL THEN '/' ELSE '<' END, 'Order', o_orderkey, 4, round(o_totalprice*100)::BIGINT, NULL, o_orderstatus FROM ord
 UNION ALL SELECT {5 * _T}+l_orderkey*100+rn, {4 * _T}+l_orderkey, '+', 'Lineitem', rn, 5, round(l_extendedprice*100)::BIGINT, l_quantity::BIGINT, l_returnflag FROM li
),
nodes AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY node_id) AS child_ord FROM raw),
anc(anc_id, node_id, dist) AS (
 SELECT node_id, node_id, 0 FROM nodes UNION ALL SELECT n.parent_id, a.node_id, a.dist+1 FROM anc a JOIN nodes n ON n.node_id = a.anc_id WHERE n.parent_id IS NOT NULL
),
kids AS (SELECT parent_id AS node_id, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1),
shape AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, coalesce(k.n_children, 0) = 0 AS is_leaf FROM nodes n LEFT JOIN kids k USING (node_id)),
walk(node_id, p) AS (
 SELECT node_id, [child_ord] FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, list_append(w.p, n.child_ord) FROM walk w JOIN nodes n ON n.parent_id = w.node_id
),
pre AS (SELECT node_id, row_number() OVER (ORDER BY p) AS tin, len(p)-1 AS depth FROM walk),
sizes AS (SELECT anc_id AS node_id, count(*) AS size FROM anc GROUP BY 1)
"""


#: The nodes alone, for what needs no way up or down.
FLAT_SQL = SALES_SQL[: SALES_SQL.index("anc(anc_id")].rstrip().rstrip(",").replace("nodes AS (", "nodes AS MATERIALIZED (")


def sales_flat_sql(body: str) -> str:
    return "WITH " + FLAT_SQL + " " + body


def sales_sql(body: str, more: str = "") -> str:
    """``body`` over the sales tree's views nodes, shape (with n_children, is_leaf), anc, pre (tin, depth), sizes."""
    return "WITH RECURSIVE " + SALES_SQL + (", " + more if more else "") + " " + body


EVENTS_SQL = """
ev AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
nodes AS (
 SELECT DISTINCT user_id::VARCHAR AS tree_id, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, '/' AS link, 'User' AS symbol, NULL::BIGINT AS cents FROM events
 UNION ALL SELECT user_id::VARCHAR, event_id+1, coalesce(prev+1, 0), CASE WHEN prev IS NULL THEN '/' ELSE '<' END, event_type, round(value*100)::BIGINT FROM ev
),
anc(tree_id, anc_id, node_id, dist) AS (
 SELECT tree_id, node_id, node_id, 0 FROM nodes
 UNION ALL SELECT a.tree_id, n.parent_id, a.node_id, a.dist+1 FROM anc a JOIN nodes n ON n.tree_id = a.tree_id AND n.node_id = a.anc_id WHERE n.parent_id IS NOT NULL
)
"""


def events_sql(body: str) -> str:
    return "WITH RECURSIVE " + EVENTS_SQL + body
