"""The queries over the sample trees, each with the same result as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..model import node
from ..operators import aggregate as A
from ..operators import compute as C
from ..operators import convert as X
from ..operators import edit as E
from ..operators import query as Q
from ..operators import schema as S
from ..operators.filters import is_filtered
from ..sources.mtg_text import mtg_lines, parse_lines, read_mtg, write_mtg
from ..storage import packed, work_dir
from .sample_trees import conversation_trees, event_trees, events_sql, sales_flat_sql, sales_sql, sales_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
REGION_1, ORDER_7 = 10**12 + 1, 4 * 10**12 + 7


def _tidy(df: DataFrame) -> DataFrame:
    """Plain bigint, string and boolean columns, without the single tree's id."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "tinyint", "smallint") else F.col(c) for c, t in df.dtypes if c != "tree_id"])


def _add(name: str, sql: str | None, tree=sales_tree, tidy: bool = True):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(tree(spark, sf_dir))
            return _tidy(out) if tidy else out

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _sales(name: str, body: str, more: str = ""):
    return _add(name, sales_sql(body, more=more))


# --- navigation -----------------------------------------------------------------------------------------------
_add("parent_values", sales_flat_sql("SELECT n.node_id, n.parent_id, p.symbol AS parent_symbol, p.cents AS parent_cents FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id"))(lambda t: Q.parents(t, "symbol", "cents"))
_sales("children_count", "SELECT parent_id AS node_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")(lambda t: Q.children(t).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")))
_sales("second_child", "SELECT parent_id AS node_id, child_ord, node_id AS child_id FROM nodes WHERE parent_id IS NOT NULL AND child_ord = 2")(lambda t: Q.children(t, 2))
_sales("last_child", "SELECT parent_id AS node_id, arg_max(node_id, child_ord) AS child_id FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")(Q.last_child)
_sales("siblings", "SELECT * FROM (SELECT node_id, count(*) OVER w - 1 AS n, (sum(node_id) OVER w - node_id)::BIGINT AS total, (sum(cents) OVER w - coalesce(cents, 0))::BIGINT AS cents FROM nodes WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id)) WHERE n > 0")(lambda t: Q.sibling_totals(t, total="node_id", cents="cents"))
for _n, _f, _s in (("next_sibling", Q.next_sibling, "lead(node_id) OVER (PARTITION BY parent_id ORDER BY child_ord)"), ("previous_sibling", Q.previous_sibling, "lag(node_id) OVER (PARTITION BY parent_id ORDER BY child_ord)"), ("last_sibling", Q.last_sibling, "arg_max(node_id, child_ord) OVER (PARTITION BY parent_id)")):
    _sales(_n, f"SELECT node_id, CASE WHEN parent_id IS NOT NULL THEN {_s} END AS sibling_id FROM nodes")(_f)
_sales("root_of", "SELECT a.node_id, a.anc_id AS root_id FROM anc a JOIN nodes n ON n.node_id = a.anc_id WHERE n.parent_id IS NULL")(Q.root_of)
_sales("get_node", f"SELECT node_id, symbol, cents FROM nodes WHERE node_id = {ORDER_7}")(lambda t: Q.get_node(t, ORDER_7).select("node_id", "symbol", "cents"))
_sales("is_leaf", "SELECT node_id, is_leaf FROM shape")(Q.is_leaf)
_sales("is_root", "SELECT node_id, parent_id IS NULL AS is_root FROM nodes")(Q.is_root)
_add("get_descendant", sales_flat_sql("SELECT d.node_id AS start_id, b.node_id FROM nodes d JOIN nodes a ON a.parent_id = d.node_id AND a.child_ord = 1 JOIN nodes b ON b.parent_id = a.node_id AND b.child_ord = 2 WHERE d.symbol = 'Customer'"))(lambda t: Q.get_descendant(t, [1, 2], "symbol = 'Customer'"))

# --- ancestors ------------------------------------------------------------------------------------------------
_LINE = "JOIN nodes s ON s.node_id = a.node_id JOIN nodes x ON x.node_id = a.anc_id WHERE s.symbol = 'Lineitem'"
_UP = "SELECT a.node_id AS start_id, a.anc_id AS node_id, a.dist, x.cents FROM anc a "
_sales("ancestors_values", _UP + _LINE + " AND a.dist > 0")(lambda t: Q.ancestors(t, "cents", "symbol = 'Lineitem'"))
_sales("ancestors_self", _UP + _LINE + " AND x.scale IN (3, 5)")(lambda t: Q.ancestors(t, "cents", "symbol = 'Lineitem'", scale=[3, 5], self=True))
_sales("ancestors_level_k", _UP + _LINE + " AND a.dist BETWEEN 1 AND 3 AND x.cents IS NOT NULL")(lambda t: Q.ancestors(t, "cents", "symbol = 'Lineitem'", recursivity_level=3, ignore_nothing=True))
_sales("ancestors_filtered_level_k", "SELECT start_id, node_id, dist, cents FROM (SELECT a.node_id AS start_id, a.anc_id AS node_id, a.dist, x.cents, row_number() OVER (PARTITION BY a.node_id ORDER BY a.dist) AS rn FROM anc a " + _LINE + " AND a.dist > 0 AND x.status = 'F') WHERE rn <= 2")(
    lambda t: Q.ancestors(t, "cents", "symbol = 'Lineitem'", where="status = 'F'", recursivity_level=2)
)
_sales("ancestors_all_false", "SELECT start_id, node_id, dist, cents FROM (SELECT a.node_id AS start_id, a.anc_id AS node_id, a.dist, x.cents, min(CASE WHEN x.symbol = 'Order' AND x.cents > 5000000 THEN NULL ELSE a.dist END) OVER (PARTITION BY a.node_id) AS stop FROM anc a " + _LINE + " AND a.dist > 0) WHERE stop IS NULL OR dist < stop")(
    lambda t: Q.ancestors(t, "cents", "symbol = 'Lineitem'", symbol="Order", where="cents > 5000000", all=False)
)
_sales("ancestors_link", "SELECT a.node_id AS start_id, count(*) AS n FROM anc a " + _LINE + " AND a.dist > 0 AND x.link = '<' GROUP BY 1")(lambda t: Q.ancestors(t, None, "symbol = 'Lineitem'", link="<").groupBy("start_id").agg(F.count(F.lit(1)).alias("n")))

# --- descendants ----------------------------------------------------------------------------------------------
_CUST = "JOIN nodes s ON s.node_id = a.anc_id JOIN nodes x ON x.node_id = a.node_id WHERE s.symbol = 'Customer'"
_DOWN = "SELECT a.anc_id AS start_id, a.node_id, a.dist, p.tin, x.cents FROM anc a JOIN pre p ON p.node_id = a.node_id " + _CUST
_sales("descendants_symbol", _DOWN + " AND a.dist > 0 AND x.symbol = 'Lineitem'")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", symbol="Lineitem"))
_sales("descendants_scale", _DOWN + " AND a.dist > 0 AND x.scale = 4")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", scale=4))
_sales("descendants_link", _DOWN + " AND a.dist > 0 AND x.link = '<'")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", link="<"))
_sales("descendants_self", _DOWN + " AND x.link = '/'")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", link="/", self=True))
_sales("descendants_depth_k", _DOWN + " AND a.dist BETWEEN 1 AND 2")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", recursivity_level=2))
_sales("descendants_where", _DOWN + " AND a.dist > 0 AND x.quantity >= 45")(lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", where="quantity >= 45"))
_FAILS = "fails AS (SELECT a.anc_id AS start_id, a.node_id FROM anc a JOIN anc b ON b.node_id = a.node_id AND b.dist < a.dist {more} JOIN nodes y ON y.node_id = b.anc_id JOIN nodes s ON s.node_id = a.anc_id WHERE s.symbol = 'Customer' AND NOT ({ok}) GROUP BY 1, 2)"
_sales("descendants_all_false", _DOWN + " AND a.dist > 0 AND NOT EXISTS (SELECT 1 FROM fails f WHERE f.start_id = a.anc_id AND f.node_id = a.node_id)", _FAILS.format(more="", ok="y.status = 'O' OR y.symbol = 'Lineitem'"))(
    lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", where="status = 'O' or symbol = 'Lineitem'", all=False)
)
_sales("descendants_ignore_null", "SELECT a.anc_id AS start_id, a.node_id, a.dist, p.tin, x.quantity FROM anc a JOIN pre p ON p.node_id = a.node_id " + _CUST + " AND a.dist > 0 AND x.quantity IS NOT NULL")(lambda t: Q.descendants(t, "quantity", "symbol = 'Customer'", ignore_nothing=True))
_sales("descendants_multi_key", "SELECT a.anc_id AS start_id, a.node_id, a.dist, p.tin, x.quantity, x.status FROM anc a JOIN pre p ON p.node_id = a.node_id " + _CUST + " AND a.dist > 0 AND x.quantity IS NOT NULL AND x.status IS NOT NULL")(
    lambda t: Q.descendants(t, ["quantity", "status"], "symbol = 'Customer'", ignore_nothing=True)
)
_sales("descendants_one_start", f"SELECT a.anc_id AS start_id, a.node_id, a.dist, p.tin, x.cents FROM anc a JOIN pre p ON p.node_id = a.node_id JOIN nodes x ON x.node_id = a.node_id WHERE a.anc_id = {REGION_1} AND a.dist > 0 AND x.symbol = 'Order'")(lambda t: Q.descendants(t, "cents", REGION_1, symbol="Order"))
_sales("descendants_list", "SELECT a.anc_id AS start_id, string_agg(x.status, '' ORDER BY p.tin) AS status FROM anc a JOIN pre p ON p.node_id = a.node_id " + _CUST + " AND a.dist > 0 AND x.symbol = 'Order' GROUP BY 1")(
    lambda t: Q.values(Q.descendants(t, "status", "symbol = 'Customer'", symbol="Order"), "status").select("start_id", F.array_join("status", "").alias("status"))
)

# --- traversal ------------------------------------------------------------------------------------------------
_sales("preorder_index", "SELECT p.node_id, p.tin, p.tin + s.size - 1 AS tout, p.depth, s.size FROM pre p JOIN sizes s USING (node_id)")(lambda t: t.indexed.select("node_id", "tin", "tout", "depth", "size"))
_sales("postorder_index", "SELECT p.node_id, row_number() OVER (ORDER BY p.tin + s.size - 1, p.depth DESC) AS tpost FROM pre p JOIN sizes s USING (node_id)")(Q.post_order)
_sales("leaves", "SELECT s.node_id, p.tin FROM shape s JOIN pre p USING (node_id) WHERE s.is_leaf")(Q.leaves)
_sales("list_nodes", "SELECT node_id, tin FROM pre")(Q.list_nodes)
_sales("traverse_level_k", "SELECT 1::BIGINT AS start_id, n.node_id, p.tin, n.symbol FROM nodes n JOIN pre p USING (node_id) WHERE p.depth <= 2")(lambda t: Q.traverse(t, "symbol", recursivity_level=3))
_sales("traverse_all_false", "SELECT 1::BIGINT AS start_id, n.node_id, p.tin, n.symbol FROM nodes n JOIN pre p USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM anc a JOIN nodes x ON x.node_id = a.anc_id WHERE a.node_id = n.node_id AND x.link = '<')")(lambda t: Q.traverse(t, "symbol", link=["/", "+"], all=False))

# --- aggregates -----------------------------------------------------------------------------------------------
_sales("subtree_sum", "SELECT a.anc_id AS start_id, sum(x.cents)::BIGINT AS cents, count(*) AS n_lines FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE a.dist > 0 AND x.symbol = 'Lineitem' GROUP BY 1")(
    lambda t: A.subtree_agg(t, symbol="Lineitem", cents=F.sum("cents"), n_lines=F.count(F.lit(1)))
)
_sales("subtree_max_quantity", "SELECT a.anc_id AS start_id, max(x.quantity) AS most, count(DISTINCT x.status) AS kinds FROM anc a JOIN nodes s ON s.node_id = a.anc_id JOIN nodes x ON x.node_id = a.node_id WHERE s.symbol = 'Nation' AND a.dist > 0 GROUP BY 1")(
    lambda t: A.subtree_ranges(t, "symbol = 'Nation'", most=("max", "quantity"), kinds=("distinct", "status"))
)
_sales("path_sum", "SELECT a.node_id AS start_id, sum(x.cents)::BIGINT AS cents, max(x.cents) AS most FROM anc a JOIN nodes x ON x.node_id = a.anc_id WHERE a.dist > 0 AND x.symbol = 'Order' GROUP BY 1")(lambda t: A.path_agg(t, symbol="Order", cents=F.sum("cents"), most=F.max("cents")))
_sales("subtree_size", "SELECT node_id, size AS n_nodes FROM sizes")(A.subtree_size)
_LEAFS = "lc AS (SELECT n.node_id, n.parent_id, n.child_ord, (SELECT 0) + coalesce(c.k, 0) AS k FROM nodes n LEFT JOIN (SELECT a.anc_id AS node_id, count(*) AS k FROM anc a JOIN shape s ON s.node_id = a.node_id WHERE a.dist > 0 AND s.is_leaf GROUP BY 1) c USING (node_id))"
_sales("leaf_count", "SELECT node_id, k::BIGINT AS n_leaves FROM lc", _LEAFS)(A.leaf_count)
_sales("nleaves", "SELECT node_id, (k + 1)::BIGINT AS nleaves FROM lc", _LEAFS)(A.nleaves)
_sales("nleaves_siblings", "SELECT node_id, (CASE WHEN parent_id IS NULL THEN 0 ELSE sum(k + 1) OVER (PARTITION BY parent_id) - k - 1 END)::BIGINT AS sum_siblings FROM lc", _LEAFS)(A.sum_siblings)
_sales("branching_order_asc", "SELECT a.node_id, (1 + sum(CASE WHEN x.link = '+' AND x.parent_id IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS branching_order FROM anc a JOIN nodes x ON x.node_id = a.anc_id GROUP BY 1")(A.branching_order)
_sales("branching_order_desc", "SELECT node_id, 1::BIGINT AS branching_order FROM nodes")(lambda t: A.branching_order(t, False))
_PLUS = "plus AS (SELECT *, symbol = 'Customer' OR symbol = 'Order' AND idx % 2 = 0 AS p FROM shape), most AS (SELECT q.anc_id AS node_id, p.node_id AS leaf, count(*) AS k FROM anc p JOIN plus x ON x.node_id = p.anc_id AND x.p AND NOT x.is_leaf JOIN shape l ON l.node_id = p.node_id AND l.is_leaf JOIN anc q ON q.node_id = p.anc_id GROUP BY 1, 2)"
_sales("branching_order_desc_plus", "SELECT n.node_id, 1 + coalesce(max(k), 0) AS branching_order FROM nodes n LEFT JOIN most USING (node_id) GROUP BY 1", _PLUS)(
    lambda t: A.branching_order(C.set_attribute(t, "link", "+", "symbol = 'Customer' or symbol = 'Order' and index % 2 = 0"), False)
)
_sales("subtree_ranges", "SELECT a.anc_id AS start_id, max(x.cents) AS most, min(x.cents) AS least, count(DISTINCT x.quantity) AS quantities, count(DISTINCT x.status) AS kinds FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE a.dist > 0 AND x.symbol IN ('Order', 'Lineitem') GROUP BY 1")(
    lambda t: A.subtree_ranges(t, symbol=["Order", "Lineitem"], most=("max", "cents"), least=("min", "cents"), quantities=("distinct", "quantity"), kinds=("distinct", "status"))
)
_sales("subtree_totals_real", "SELECT a.anc_id AS start_id, count(*) AS n, round(sum(x.cents / 100.0), 2) AS money, sum(x.cents)::BIGINT AS exact FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE a.dist > 0 AND x.symbol = 'Lineitem' GROUP BY 1")(
    lambda t: A.subtree_totals(C.mutate(t, {"money": "cast(cents as double) / 100", "exact": "cast(cents as decimal(14,2)) / 100"}), symbol="Lineitem", money="money", exact="exact").select("start_id", "n", F.round("money", 2).alias("money"), (F.col("exact") * 100).cast("bigint").alias("exact"))
)
_sales("pipe_model", "SELECT node_id, round(v, 6) AS pipe FROM pipe", _LEAFS + ", pipe(node_id, v) AS (SELECT node_id, 1000.0::DOUBLE FROM nodes WHERE parent_id IS NULL UNION ALL SELECT s.node_id, p.v * s.share FROM pipe p JOIN (SELECT node_id, parent_id, (k + 1)::DOUBLE / sum(k + 1) OVER (PARTITION BY parent_id) AS share FROM lc) s ON s.parent_id = p.node_id)")(
    lambda t: A.pipe_model(t, 1000.0).select("node_id", F.round("pipe", 6).alias("pipe"))
)
# no value is negative here, so no sibling is taken out of a pool
_sales("pipe_model_threshold", "SELECT node_id, round(v, 4) AS pipe FROM pipe", _LEAFS + ", girth AS (SELECT node_id, abs(coalesce(cents, 0))::DOUBLE AS g FROM nodes), pipe(node_id, v) AS (SELECT n.node_id, g.g FROM nodes n JOIN girth g USING (node_id) WHERE n.parent_id IS NULL UNION ALL SELECT s.node_id, CASE WHEN s.g > 3000000 THEN s.g ELSE p.v * s.share END FROM pipe p JOIN (SELECT node_id, parent_id, g, (k + 1)::DOUBLE / sum(k + 1) OVER (PARTITION BY parent_id) AS share FROM lc JOIN girth USING (node_id)) s ON s.parent_id = p.node_id)")(
    lambda t: A.pipe_model_threshold(C.mutate(t, {"girth": "abs(coalesce(cents, 0))"}), "girth", 3000000.0).select("node_id", F.round("pipe", 4).alias("pipe"))
)
_sales("get_classes", "SELECT n.symbol AS SYMBOL, n.scale::BIGINT AS SCALE, 'FREE' AS DECOMPOSITION, 'FREE' AS INDEXATION, 'IMPLICIT' AS DEFINITION, min(p.tin) AS first_tin FROM nodes n JOIN pre p USING (node_id) GROUP BY 1, 2")(A.get_classes)
_sales("get_features", "SELECT * FROM (VALUES ('cents', 'INT'), ('quantity', 'INT'), ('status', 'STRING')) t(NAME, TYPE)")(A.get_features)
_sales("scales", "SELECT n.scale::BIGINT AS scale, min(p.tin) AS first_tin FROM nodes n JOIN pre p USING (node_id) GROUP BY 1")(A.scales)
_sales("symbols", "SELECT n.symbol, min(p.tin) AS first_tin FROM nodes n JOIN pre p USING (node_id) GROUP BY 1")(A.symbols)
_sales("max_id", "SELECT max(node_id) AS max_id FROM nodes")(A.max_id)
_sales("new_id", "SELECT max(node_id) + 1 AS new_id FROM nodes")(A.new_id)

# --- attributes -----------------------------------------------------------------------------------------------
_sales("transform_columns", "SELECT node_id, cents * 2 AS twice, CASE WHEN cents IS NOT NULL AND quantity IS NOT NULL THEN cents - quantity END AS rest FROM nodes")(
    lambda t: C.transform(C.transform(t, ("cents", lambda c: c * 2, "twice")), (["cents", "quantity"], lambda c, q: c - q, "rest"), ignore_nothing=True).nodes.select("node_id", "twice", "rest")
)
_sales("transform_filtered", "SELECT node_id, CASE WHEN symbol = 'Order' THEN cents + 1 ELSE cents END AS cents FROM nodes")(lambda t: C.transform(t, ("cents", lambda c: c + 1, "cents"), symbol="Order").nodes.select("node_id", "cents"))
_sales("transform_subtree", "SELECT n.node_id, CASE WHEN n.symbol = 'Customer' THEN s.v END AS sold FROM nodes n LEFT JOIN (SELECT a.anc_id, sum(x.cents)::BIGINT AS v FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE a.dist > 0 AND x.symbol = 'Lineitem' GROUP BY 1) s ON s.anc_id = n.node_id")(
    lambda t: C.transform(t, (lambda t: A.subtree_agg(t, symbol="Lineitem", sold=F.sum("cents")), "sold"), symbol="Customer").nodes.select("node_id", "sold")
)
_sales("transform_rename", "SELECT node_id, CASE WHEN symbol <> 'Order' THEN status END AS status, CASE WHEN symbol = 'Order' THEN status END AS state FROM nodes")(lambda t: C.transform(t, ("status", "state"), symbol="Order").nodes.select("node_id", "status", "state"))
_sales("select_columns", "SELECT node_id, symbol, quantity, cents // 100 AS whole FROM nodes WHERE symbol IN ('Order', 'Lineitem')")(
    lambda t: C.select(t, "quantity", ("cents", lambda c: F.floor(c / 100), "whole")).nodes.where("symbol in ('Order', 'Lineitem')").select("node_id", "symbol", "quantity", "whole")
)
_sales("mutate", "SELECT node_id, CASE WHEN scale = 5 THEN cents * quantity END AS total, CASE WHEN scale = 5 THEN cents * quantity + 1 END AS more FROM nodes")(lambda t: C.mutate(t, {"total": "cents * quantity", "more": "total + 1"}, scale=5).nodes.select("node_id", "total", "more"))
_sales("mutate_all_false", "SELECT n.node_id, CASE WHEN p.tin < (SELECT min(q.tin) FROM pre q JOIN nodes m USING (node_id) WHERE m.link = '<') THEN 1 END::BIGINT AS seen FROM nodes n JOIN pre p USING (node_id)")(lambda t: C.mutate(t, {"seen": F.lit(1)}, link=["/", "+"], all=False).nodes.select("node_id", "seen"))
_sales("set_attribute", f"SELECT node_id, CASE WHEN node_id = {ORDER_7} THEN 'X' ELSE status END AS status FROM nodes")(lambda t: C.set_attribute(t, "status", "X", F.col("node_id") == ORDER_7).nodes.select("node_id", "status"))
_sales("attribute_default", "SELECT node_id, CASE WHEN symbol = 'Lineitem' THEN quantity ELSE -1 END AS quantity FROM nodes")(lambda t: C.attribute(t, "quantity", -1))
_sales("add_column", "SELECT node_id, CASE WHEN symbol IN ('Nation', 'Region') THEN 3 END::BIGINT AS level FROM nodes")(lambda t: S.add_column(t, ["Nation", "Region"], "level", "bigint", 3).nodes.select("node_id", "level"))
_sales("drop_column", "SELECT node_id, CASE WHEN symbol <> 'Order' THEN cents END AS cents FROM nodes")(lambda t: S.drop_column(t, "Order", "cents").nodes.select("node_id", "cents"))
_sales("rename_column", "SELECT node_id, CASE WHEN symbol <> 'Lineitem' THEN cents END AS cents, CASE WHEN symbol = 'Lineitem' THEN cents END AS price FROM nodes")(lambda t: S.rename_column(t, "Lineitem", "cents", "price").nodes.select("node_id", "cents", "price"))
_sales("pop", "SELECT node_id, status FROM nodes WHERE symbol = 'Order'")(lambda t: C.pop(t, "status", "Order")[0])
_sales("equal_nodes", f"SELECT node_id, node_id <> {ORDER_7} AS equal FROM nodes")(lambda t: C.equal_nodes(t, C.set_attribute(t, "status", "X", F.col("node_id") == ORDER_7)))

# --- tables and graphs ----------------------------------------------------------------------------------------
_sales("to_table", 'SELECT n.node_id, n.symbol, n.scale::BIGINT AS scale, n.idx AS "index", n.link, n.parent_id, n.cents, n.quantity, n.status, p.tin FROM nodes n JOIN pre p USING (node_id)')(X.to_table)
_sales("symbol_table", "SELECT node_id, cents, status FROM nodes WHERE symbol = 'Order'")(lambda t: X.symbol_table(t, "Order"))
_sales("graph_edges", "SELECT parent_id AS src, node_id AS dst, link, 1.0::DOUBLE AS weight FROM nodes WHERE parent_id IS NOT NULL")(lambda t: X.to_graph(t)[1])
_sales("graph_vertices", 'SELECT node_id AS id, symbol, idx AS "index", scale::BIGINT AS scale, cents, quantity, status FROM nodes')(lambda t: X.to_graph(t)[0])

# --- edits ----------------------------------------------------------------------------------------------------
_TOPO = ["node_id", "parent_id", "child_ord", "link", "symbol"]
_NEW = {"link": "/", "symbol": "Group", "index": 1, "scale": 9}
_RANK = "m AS (SELECT n.node_id, n.parent_id, n.child_ord, (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY p.tin + s.size - 1, p.depth DESC) AS new FROM nodes n JOIN pre p USING (node_id) JOIN sizes s USING (node_id) WHERE n.symbol = 'Customer')"
_ALLROWS = "SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY f, o, node_id) AS child_ord, link, symbol FROM ("
_sales("insert_parents", _ALLROWS + "SELECT n.node_id, coalesce(m.new, n.parent_id) AS parent_id, 0 AS f, n.child_ord AS o, n.link, n.symbol FROM nodes n LEFT JOIN m USING (node_id) UNION ALL SELECT new, parent_id, 1, child_ord, '/', 'Group' FROM m)", _RANK)(
    lambda t: E.insert_parents(t, _NEW, symbol="Customer").nodes.select(*_TOPO)
)
_sales("insert_children", _ALLROWS + "SELECT node_id, parent_id, 0 AS f, child_ord AS o, link, symbol FROM nodes UNION ALL SELECT new, node_id, 1, 0, '/', 'Group' FROM m)", _RANK)(lambda t: E.insert_children(t, _NEW, symbol="Customer").nodes.select(*_TOPO))
_sales("insert_siblings", _ALLROWS + "SELECT node_id, parent_id, 0 AS f, child_ord AS o, link, symbol FROM nodes UNION ALL SELECT new, parent_id, 1, child_ord, '/', 'Group' FROM m)", _RANK)(lambda t: E.insert_siblings(t, _NEW, symbol="Customer").nodes.select(*_TOPO))
_sales("insert_generations", _ALLROWS + "SELECT n.node_id, coalesce(m.new, n.parent_id) AS parent_id, 0 AS f, n.child_ord AS o, n.link, n.symbol FROM nodes n LEFT JOIN m ON m.node_id = n.parent_id UNION ALL SELECT new, node_id, 1, 0, '/', 'Group' FROM m)", _RANK)(
    lambda t: E.insert_generations(t, _NEW, symbol="Customer").nodes.select(*_TOPO)
)
_sales("insert_child_attributes", "SELECT (SELECT max(node_id) FROM nodes) + 1 AS node_id, node_id AS parent_id, cents * 2 AS cents FROM nodes WHERE node_id = " + str(ORDER_7))(
    lambda t: E.insert_child(t, ORDER_7, _NEW, {"cents": F.col("cents") * 2}).nodes.where("symbol = 'Group'").select("node_id", "parent_id", "cents")
)
# new parents, links and order keys by climbing over deleted nodes one by one
_CLIMB = (
    "gone AS (SELECT node_id FROM nodes WHERE {gone}), "
    "climb(node_id, cur, link, key) AS (SELECT n.node_id, n.parent_id, n.link, [[0, n.child_ord]] FROM nodes n WHERE n.node_id NOT IN (SELECT node_id FROM gone) "
    "UNION ALL SELECT c.node_id, d.parent_id, {rule}, list_concat([[1, d.child_ord]], c.key) FROM climb c JOIN nodes d ON d.node_id = c.cur WHERE d.node_id IN (SELECT node_id FROM gone)), "
    "done AS (SELECT c.*, row_number() OVER (PARTITION BY cur ORDER BY key) AS child_ord FROM climb c WHERE cur IS NULL OR cur NOT IN (SELECT node_id FROM gone))"
)
_RULE = "CASE WHEN c.link = '<' AND d.link IN ('/', '+') THEN d.link ELSE c.link END"
_DONE = "SELECT d.node_id, d.cur AS parent_id, d.child_ord, d.link, n.symbol FROM done d JOIN nodes n USING (node_id)"
_sales("delete_nodes_scale", _DONE, _CLIMB.format(gone="scale = 2", rule=_RULE))(lambda t: E.delete_nodes(t, scale=2).nodes.select(*_TOPO))
_sales("delete_nodes_link_rules", _DONE, _CLIMB.format(gone="symbol = 'Order' AND status = 'F'", rule=_RULE))(lambda t: E.delete_nodes(t, symbol="Order", where="status = 'F'").nodes.select(*_TOPO))
_sales("delete_nodes_keep_link", _DONE, _CLIMB.format(gone="symbol = 'Order' AND status <> 'F'", rule="c.link"))(lambda t: E.delete_nodes(t, symbol="Order", where="status <> 'F'", child_link=lambda c, d: c).nodes.select(*_TOPO))
_sales("delete_node", _DONE, _CLIMB.format(gone=f"node_id = {ORDER_7}", rule=_RULE))(lambda t: E.delete_node(t, ORDER_7).nodes.select(*_TOPO))
_SEG = "seg AS (SELECT s.node_id FROM shape s JOIN nodes p ON p.node_id = s.parent_id JOIN nodes c ON c.parent_id = s.node_id WHERE s.n_children = 1 AND p.parent_id IS NOT NULL AND c.link <> '+')"
_sales("is_segment", "SELECT node_id, node_id IN (SELECT node_id FROM seg) AS is_segment FROM nodes", _SEG)(E.is_segment)
_sales("delete_segments", _DONE, _SEG + ", " + _CLIMB.format(gone="node_id IN (SELECT node_id FROM seg)", rule="CASE WHEN d.link IN ('/', '+') THEN d.link ELSE c.link END"))(lambda t: E.delete_segments(t).nodes.select(*_TOPO))
_sales("prune", f"SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY child_ord) AS child_ord, link, symbol FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM anc a WHERE a.node_id = n.node_id AND a.anc_id = {REGION_1})")(lambda t: E.prune(t, REGION_1).nodes.select(*_TOPO))
_sales("attach_subtree", "SELECT node_id, parent_id, symbol FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + p.tin, coalesce((SELECT max(node_id) FROM nodes) + q.tin, " + str(REGION_1) + "), n.symbol FROM nodes n JOIN pre p USING (node_id) LEFT JOIN pre q ON q.node_id = n.parent_id")(
    lambda t: E.attach(t, t, REGION_1)[0].nodes.select("node_id", "parent_id", "symbol")
)
_sales("move_subtree", f"SELECT node_id, CASE WHEN node_id = {REGION_1} THEN {10**12} ELSE parent_id END AS parent_id FROM nodes")(lambda t: E.move(t, REGION_1, 10**12).nodes.select("node_id", "parent_id"))

# --- the text format ------------------------------------------------------------------------------------------
_LEADS = "last AS (SELECT *, parent_id IS NULL OR row_number() OVER (PARTITION BY parent_id ORDER BY child_ord DESC) = 1 AS is_last FROM nodes), lead AS (SELECT a.node_id, sum(CASE WHEN l.is_last THEN 0 ELSE 1 END) AS k FROM anc a JOIN last l ON l.node_id = a.anc_id GROUP BY 1)"
_sales(
    "mtg_write_lines",
    "SELECT p.tin AS seq, concat(repeat(chr(9), k::BIGINT), CASE WHEN l.is_last AND l.parent_id IS NOT NULL THEN '^' ELSE '' END, l.link, l.symbol, l.idx::VARCHAR, repeat(chr(9), (m - k)::BIGINT), chr(9), coalesce(l.cents::VARCHAR, ''), chr(9), coalesce(l.quantity::VARCHAR, ''), chr(9), coalesce(l.status, '')) AS line FROM last l JOIN lead USING (node_id) JOIN pre p USING (node_id), (SELECT max(k) AS m FROM lead)",
    _LEADS,
)(lambda t: mtg_lines(t, features=[("cents", "INT"), ("quantity", "INT"), ("status", "STRING")]).where("section = 4 and seq > 0").select("seq", "line"))
_sales("mtg_write_lead", "SELECT p.tin AS seq, k::BIGINT AS tabs FROM lead JOIN pre p USING (node_id)", _LEADS)(lambda t: mtg_lines(t, features=[]).where("section = 4 and seq > 0").select("seq", (F.length("line") - F.length(F.ltrim(F.col("line"), F.lit("\t")))).cast("bigint").alias("tabs")))



def _written_and_read(t, *attributes):
    lines = mtg_lines(t, features=[(n, "STRING" if n == "status" else "INT") for n in attributes])
    numbered = lines.select(F.col("tree_id").alias("file"), (F.col("section") * (1 << 48) + F.col("seq")).alias("n"), "line")
    return parse_lines(packed(numbered, "mtg-lines")).nodes.select("node_id", "parent_id", "child_ord", "link", "symbol", "index", "scale", *attributes)


_READ = 'SELECT p.tin AS node_id, q.tin AS parent_id, n.child_ord, n.link, n.symbol, n.idx AS "index", n.scale::BIGINT AS scale, n.cents, n.quantity, n.status FROM nodes n JOIN pre p USING (node_id) LEFT JOIN pre q ON q.node_id = n.parent_id'
_sales("mtg_read", _READ)(lambda t: _written_and_read(t, "cents", "quantity", "status"))



def _files_round_trip(t):
    path = f"{work_dir(t.spark)}/mtg-files-{uuid.uuid4().hex}"
    write_mtg(t, path)
    return read_mtg(t.spark, path, "stem").nodes.select("tree_id", "node_id", "parent_id", "child_ord", "link", "symbol", "scale", "chars")


_add("mtg_files_round_trip", "SELECT conv_id::VARCHAR AS tree_id, n AS node_id, CASE WHEN n > 1 THEN n - 1 END AS parent_id, 1::INT AS child_ord, CASE WHEN n > 1 THEN '<' ELSE '/' END AS link, role AS symbol, 1::INT AS scale, length(coalesce(text, ''))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)", conversation_trees, False)(_files_round_trip)

# --- many trees with long chains ------------------------------------------------------------------------------
_add("events_subtree_sum", events_sql("SELECT a.tree_id, a.anc_id AS start_id, sum(n.cents)::BIGINT AS cents, count(*) AS n FROM anc a JOIN nodes n ON n.tree_id = a.tree_id AND n.node_id = a.node_id WHERE a.dist > 0 GROUP BY 1, 2"), event_trees, False)(
    lambda t: A.subtree_totals(t, cents="cents")
)
_add("events_previous_purchases", events_sql("SELECT tree_id, start_id, node_id, dist, cents FROM (SELECT a.tree_id, a.node_id AS start_id, a.anc_id AS node_id, a.dist::BIGINT AS dist, n.cents, row_number() OVER (PARTITION BY a.tree_id, a.node_id ORDER BY a.dist) AS rn FROM anc a JOIN nodes n ON n.tree_id = a.tree_id AND n.node_id = a.anc_id WHERE a.dist > 0 AND n.symbol = 'purchase') WHERE rn <= 3"), event_trees, False)(
    lambda t: Q.ancestors(t, "cents", symbol="purchase", recursivity_level=3).withColumn("dist", F.col("dist").cast("bigint"))
)
_add("conversation_paths", "SELECT conv_id::VARCHAR AS tree_id, turn AS start_id, sum(length(coalesce(text, ''))) OVER w::BIGINT AS chars, count(*) FILTER (role = 'user') OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", conversation_trees, False)(
    lambda t: A.path_agg(t, self=True, chars=F.sum("chars"), asked=F.count(F.when(F.col("symbol") == "user", 1)))
)

# --- filters that navigate, single attributes, caches ----------------------------------------------------------
_sales("filter_by_parent", _DOWN + " AND a.dist > 0 AND x.symbol = 'Lineitem' AND (SELECT o.status FROM nodes o WHERE o.node_id = x.parent_id) = 'F'")(
    lambda t: Q.descendants(t, "cents", "symbol = 'Customer'", symbol="Lineitem", where=lambda t: Q.parents(t, "status").where("parent_status = 'F'"))
)
_sales("filter_by_children", "SELECT n.node_id, CASE WHEN n.symbol = 'Order' AND (SELECT count(*) FROM nodes c WHERE c.parent_id = n.node_id AND c.symbol = 'Lineitem') > 5 THEN 1 ELSE NULL END::BIGINT AS large FROM nodes n")(
    lambda t: C.mutate(t, {"large": F.lit(1)}, symbol="Order", where=lambda t: Q.children(t).join(t.nodes.where("symbol = 'Lineitem'").select("tree_id", F.col("node_id").alias("child_id")), ["tree_id", "child_id"]).groupBy("tree_id", "node_id").count().where("count > 5")).nodes.select("node_id", "large")
)
_sales("subtree_totals", "SELECT a.anc_id AS start_id, count(*) AS n, sum(x.cents)::BIGINT AS cents FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE x.symbol = 'Order' GROUP BY 1")(lambda t: A.subtree_totals(t, self=True, symbol="Order", cents="cents"))
_sales("set_encoding", "SELECT node_id, CASE WHEN symbol = 'Order' THEN '+' ELSE link END AS link, CASE WHEN symbol = 'Order' THEN 'Sale' ELSE symbol END AS symbol, CASE WHEN symbol = 'Order' THEN 7 ELSE scale END::BIGINT AS scale, CASE WHEN symbol = 'Order' THEN 0 ELSE idx END::BIGINT AS \"index\" FROM nodes")(
    lambda t: _encoded(t).nodes.select("node_id", "link", "symbol", "scale", "index")
)


def _encoded(t):
    for name, value in (("link", "+"), ("scale", 7), ("index", 0), ("symbol", "Sale")):
        t = C.set_attribute(t, name, value, "symbol = 'Order'")
    return t


_sales("attributes_struct", "SELECT node_id, cents, quantity, status FROM nodes")(lambda t: C.attributes(t).select("node_id", "attributes.*"))
_sales("attributes_map", "SELECT node_id, cents::VARCHAR AS cents, status FROM nodes")(lambda t: C.attributes(t, "map").select("node_id", F.col("attributes")["cents"].alias("cents"), F.col("attributes")["status"].alias("status")))
_sales("attribute_names", "SELECT * FROM (VALUES ('cents'), ('quantity'), ('status')) t(name)")(lambda t: t.spark.createDataFrame([(a,) for a in A.attribute_names(t)], "name string"))
_sales("attribute_names_below", f"SELECT * FROM (VALUES ('cents'), ('quantity'), ('status')) t(name)")(lambda t: t.spark.createDataFrame([(a,) for a in A.attribute_names(t, ORDER_7)], "name string"))
_sales("has_attribute", "SELECT DISTINCT symbol, symbol IN ('Customer', 'Order', 'Lineitem') AS cents, symbol = 'Lineitem' AS quantity FROM nodes")(
    lambda t: t.nodes.select("symbol").distinct().withColumns({a: F.col("symbol").isin([s for s in t.catalog if t.has(s, a)]) for a in ("cents", "quantity")})
)
_sales("append_attributes", f"SELECT node_id, CASE WHEN node_id = {ORDER_7} THEN 5 ELSE cents END AS cents, CASE WHEN node_id = {ORDER_7} THEN 'new' END AS note FROM nodes")(lambda t: C.append(t, {"cents": 5, "note": "new"}, F.col("node_id") == ORDER_7).nodes.select("node_id", "cents", "note"))
_sales("is_filtered", "SELECT node_id, coalesce(symbol = 'Order' AND link = '<' AND cents > 5000000, false) AS passes FROM nodes")(lambda t: t.nodes.select("node_id", is_filtered(t, symbol="Order", link="<", where="cents > 5000000").alias("passes")))
_sales("transform_auto_name", "SELECT node_id, sqrt(quantity) AS quantity_sqrt, cents + quantity AS cents_quantity_function FROM nodes")(
    lambda t: C.transform(t, ("quantity", F.sqrt), (["cents", "quantity"], lambda a, b: a + b)).nodes.select("node_id", "quantity_sqrt", "cents_quantity_function")
)
_sales("transform_tree_function", "SELECT node_id, cents, 1::BIGINT AS seen FROM nodes WHERE symbol = 'Nation'")(lambda t: C.transform(t, lambda t: C.mutate(t, {"seen": F.lit(1)}, symbol="Nation")).nodes.where("symbol = 'Nation'").select("node_id", "cents", "seen"))
_sales("cached_nodes", "SELECT 1::BIGINT AS start_id, n.node_id, p.tin, n.cents FROM nodes n JOIN pre p USING (node_id) WHERE n.symbol = 'Order'")(lambda t: _cached(t))
_sales("cached_values", "SELECT a.anc_id AS start_id, string_agg(x.status, '' ORDER BY p.tin) AS status FROM anc a JOIN pre p ON p.node_id = a.node_id " + _CUST + " AND a.dist > 0 AND x.symbol = 'Order' GROUP BY 1")(lambda t: _cached_values(t))


def _cached(t):
    cache = Q.NodeCache(t)
    cache.cache_nodes(symbol="Order")
    return cache.traverse("cents", symbol="Order")


def _cached_values(t):
    cache = Q.NodeCache(t)
    cache.cache_values("status", start="symbol = 'Customer'", symbol="Order")
    return cache.descendants("status", start="symbol = 'Customer'", symbol="Order").select("start_id", F.array_join("status", "").alias("status"))


# --- more edits ---------------------------------------------------------------------------------------------
_ONE = "SELECT node_id, parent_id, child_ord, link, symbol FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + 1, {parent}, {place}, '/', 'Group'"
_sales("insert_parent", f"SELECT node_id, CASE WHEN node_id = {ORDER_7} THEN (SELECT max(node_id) FROM nodes) + 1 ELSE parent_id END AS parent_id, symbol FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + 1, (SELECT parent_id FROM nodes WHERE node_id = {ORDER_7}), 'Group'")(lambda t: E.insert_parent(t, ORDER_7, _NEW).nodes.select("node_id", "parent_id", "symbol"))
_sales("insert_sibling", _ONE.format(parent=f"(SELECT parent_id FROM nodes WHERE node_id = {ORDER_7})", place=f"(SELECT count(*) + 1 FROM nodes WHERE parent_id = (SELECT parent_id FROM nodes WHERE node_id = {ORDER_7}))"))(lambda t: E.insert_sibling(t, ORDER_7, _NEW).nodes.select(*_TOPO))
_sales("insert_generation", f"SELECT node_id, CASE WHEN parent_id = {ORDER_7} THEN (SELECT max(node_id) FROM nodes) + 1 ELSE parent_id END AS parent_id, symbol FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + 1, {ORDER_7}, 'Group'")(lambda t: E.insert_generation(t, ORDER_7, _NEW).nodes.select("node_id", "parent_id", "symbol"))
_sales("insert_children_all_false", "SELECT (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY p.tin + s.size - 1, p.depth DESC) AS node_id, n.node_id AS parent_id FROM nodes n JOIN pre p USING (node_id) JOIN sizes s USING (node_id) WHERE n.symbol = 'Order' AND n.link = '/'")(lambda t: E.insert_children(t, _NEW, symbol="Order", all=False).nodes.where("symbol = 'Group'").select("node_id", "parent_id"))
_sales("delete_nodes_all_false", "SELECT node_id, parent_id, symbol FROM nodes")(lambda t: E.delete_nodes(t, symbol="Order", all=False).nodes.select("node_id", "parent_id", "symbol"))
_sales("delete_bare", "SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY child_ord) AS child_ord FROM nodes n WHERE EXISTS (SELECT 1 FROM anc a JOIN nodes x ON x.node_id = a.node_id WHERE a.anc_id = n.node_id AND NOT (x.symbol IN ('Lineitem', 'Order') AND coalesce(x.status, '') <> 'F'))")(lambda t: E.delete_bare(t, symbol=["Lineitem", "Order"], where="coalesce(status, '') <> 'F'").nodes.select("node_id", "parent_id", "child_ord"))
_sales("rechildren", f"SELECT node_id, CASE WHEN node_id = {ORDER_7} THEN {REGION_1} WHEN parent_id = {REGION_1} THEN NULL ELSE parent_id END AS parent_id FROM nodes")(lambda t: E.rechildren(t, REGION_1, [ORDER_7]).nodes.select("node_id", "parent_id"))
_sales("replace_child", f"SELECT node_id, CASE WHEN node_id = {ORDER_7} THEN {REGION_1} WHEN parent_id = {REGION_1} AND child_ord = 2 THEN NULL ELSE parent_id END AS parent_id, CASE WHEN node_id = {ORDER_7} THEN 2 END::BIGINT AS place FROM nodes")(lambda t: E.replace_child(t, REGION_1, 2, ORDER_7).nodes.select("node_id", "parent_id", F.when(F.col("node_id") == ORDER_7, F.col("child_ord")).alias("place")))
_sales("unify", "SELECT node_id, cents::DOUBLE AS cents, status FROM nodes UNION ALL SELECT 1, 2.5, NULL")(lambda t: S.unify(t, node(t.spark, "/", "Scene", attributes={"cents": 2.5}, tree_id="other")).nodes.select("node_id", "cents", "status"))

# --- single nodes of one of many trees: every conversation has the same turn numbers ----------------------------
_TALK = "talk AS (SELECT conv_id::VARCHAR AS tree_id, turn AS node_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, role AS symbol FROM conversations), one AS (SELECT min(tree_id) AS tree_id FROM talk), second AS (SELECT min(node_id) AS node_id FROM talk JOIN one USING (tree_id) WHERE parent_id IS NOT NULL) "


def _one_tree(edit):
    """The edit of the second node of one conversation, named by its tree and id."""

    def run(t):
        tree_id = t.nodes.agg(F.min("tree_id")).head()[0]
        node_id = t.nodes.where((F.col("tree_id") == tree_id) & F.col("parent_id").isNotNull()).agg(F.min("node_id")).head()[0]
        return edit(t, node_id, tree_id).nodes.select("tree_id", "node_id", "parent_id", "symbol")

    return run


_add("prune_one_tree", "WITH " + _TALK + "SELECT t.* FROM talk t, one, second WHERE NOT (t.tree_id = one.tree_id AND t.node_id >= second.node_id)", conversation_trees, False)(_one_tree(lambda t, n, tree: E.prune(t, n, tree)))
_add("delete_node_one_tree", "WITH " + _TALK + "SELECT t.tree_id, t.node_id, CASE WHEN t.tree_id = one.tree_id AND t.parent_id = second.node_id THEN (SELECT parent_id FROM talk x WHERE x.tree_id = one.tree_id AND x.node_id = second.node_id) ELSE t.parent_id END AS parent_id, t.symbol FROM talk t, one, second WHERE NOT (t.tree_id = one.tree_id AND t.node_id = second.node_id)", conversation_trees, False)(_one_tree(lambda t, n, tree: E.delete_node(t, n, tree_id=tree)))
_add("insert_child_one_tree", "WITH " + _TALK + "SELECT * FROM talk UNION ALL SELECT tree_id, (SELECT max(node_id) + 1 FROM talk x WHERE x.tree_id = one.tree_id), second.node_id, 'Group' FROM one, second", conversation_trees, False)(_one_tree(lambda t, n, tree: E.insert_child(t, n, _NEW, tree_id=tree)))
_add("move_one_tree", "WITH " + _TALK + "SELECT t.tree_id, t.node_id, CASE WHEN t.tree_id = one.tree_id AND t.parent_id = second.node_id THEN (SELECT parent_id FROM talk x WHERE x.tree_id = one.tree_id AND x.node_id = second.node_id) ELSE t.parent_id END AS parent_id, t.symbol FROM talk t, one, second", conversation_trees, False)(_one_tree(lambda t, n, tree: _moved(t, n, tree)))


def _moved(t, n, tree):
    """The child of a node goes to the node's parent."""
    child, up = (t.nodes.where((F.col("tree_id") == tree) & c).agg(F.min(v)).head()[0] for c, v in ((F.col("parent_id") == n, "node_id"), (F.col("node_id") == n, "parent_id")))
    return t if child is None else E.move(t, child, up, tree)
