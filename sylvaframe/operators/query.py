"""Navigation: parents, children, siblings, ancestors, descendants, traversal.

Everything is asked for all start nodes of all trees at once; ``start`` narrows it to some.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import Filter, navigating
from .index import KEY, last_before, path_sums


def get_node(tree, node_id: int, below: int | None = None) -> DataFrame:
    """The row of a node; with ``below`` only if it lies in that node's subtree."""
    rows = tree.nodes.where(F.col("node_id") == node_id)
    return rows if below is None else tree.inside(below).where(F.col("node_id") == node_id).select(rows.columns)


def root_of(tree) -> DataFrame:
    return tree.indexed.select(*KEY, "root_id")


def parents(tree, *columns: str) -> DataFrame:
    """Every node with its parent's id and, as ``parent_<name>``, columns of the parent (null for roots)."""
    if not columns:
        return tree.nodes.select(*KEY, "parent_id")
    up = tree.nodes.select("tree_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return tree.nodes.select(*KEY, "parent_id").join(up, ["tree_id", "parent_id"], "left").select(*KEY, "parent_id", *[f"parent_{c}" for c in columns])


def children(tree, nth: int | None = None) -> DataFrame:
    """(tree_id, node_id, child_ord, child_id): the ordered children of every node, or the n-th (from 1)."""
    rows = tree.nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"), "child_ord", F.col("node_id").alias("child_id"))
    return rows if nth is None else rows.where(F.col("child_ord") == nth)


def last_child(tree) -> DataFrame:
    return children(tree).groupBy(*KEY).agg(F.max_by("child_id", "child_ord").alias("child_id"))


def siblings(tree) -> DataFrame:
    """(tree_id, node_id, sibling_id, child_ord): the others under the same parent. Roots have no rows."""
    n = tree.nodes.where("parent_id is not null").select("tree_id", "parent_id", "node_id")
    other = tree.nodes.select("tree_id", "parent_id", F.col("node_id").alias("sibling_id"), "child_ord")
    return n.join(other, ["tree_id", "parent_id"]).where("node_id <> sibling_id").select(*KEY, "sibling_id", "child_ord")


def sibling_totals(tree, **columns: str) -> DataFrame:
    """``n``, how many siblings a node has, and by name the sum of a column of whole numbers or decimals over them, of every node that has any.

    The parent's totals minus the node's own values, so a parent of n children gives n rows, where ``siblings`` has n^2.
    A sum is null where no sibling has a value.
    """
    kinds = dict(tree.nodes.dtypes)
    if odd := [c for c in columns.values() if not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "decimal"))]:
        raise TypeError(f"sums without a node's own value are exact for whole numbers and decimals only, not for {', '.join(odd)}: cast to a decimal")
    own = tree.nodes.where("parent_id is not null").select(*KEY, "parent_id", *[F.col(c).alias(f"_own_{k}") for k, c in columns.items()])
    sums = [a for k in columns for a in (F.sum(f"_own_{k}").alias(f"_sum_{k}"), F.count(f"_own_{k}").alias(f"_has_{k}"))]
    total = own.groupBy("tree_id", "parent_id").agg(F.count(F.lit(1)).alias("_many"), *sums).where("_many > 1")
    rest = [F.when(F.col(f"_has_{k}") > F.col(f"_own_{k}").isNotNull().cast("int"), F.col(f"_sum_{k}") - F.coalesce(f"_own_{k}", F.lit(0))).alias(k) for k in columns]
    return own.join(total, ["tree_id", "parent_id"]).select(*KEY, (F.col("_many") - 1).alias("n"), *rest)


def _neighbour(tree, order: Column) -> DataFrame:
    """The sibling that comes before by an order of the children, in stretches of it, so that a parent of millions is no single task."""
    rows = tree.nodes.where("parent_id is not null").select(*KEY, "parent_id", order.alias("_place"))
    near = last_before(rows, ["tree_id", "parent_id"], "_place", "node_id", "sibling_id").select(*KEY, "sibling_id")
    return near.union(tree.nodes.where("parent_id is null").select(*KEY, F.lit(None).cast("bigint")))


def next_sibling(tree) -> DataFrame:
    return _neighbour(tree, -F.col("child_ord"))


def previous_sibling(tree) -> DataFrame:
    return _neighbour(tree, F.col("child_ord"))


def last_sibling(tree) -> DataFrame:
    """The last child of the parent, which may be the node itself."""
    last = last_child(tree).select("tree_id", F.col("node_id").alias("parent_id"), F.col("child_id").alias("sibling_id"))
    return tree.nodes.select(*KEY, "parent_id").join(last, ["tree_id", "parent_id"], "left").select(*KEY, "sibling_id")


def is_leaf(tree) -> DataFrame:
    return tree.indexed.select(*KEY, "is_leaf")


def is_root(tree) -> DataFrame:
    return tree.nodes.select(*KEY, F.col("parent_id").isNull().alias("is_root"))


def _keys(key) -> list[str]:
    return [] if key is None else [key] if isinstance(key, str) else list(key)


def _failures(tree, passes: Column) -> DataFrame:
    """``fails`` (does the node itself fail) and ``fail_cum`` (failing nodes on its path, itself included)."""
    flag = F.when(passes, 0).otherwise(1)
    return tree.indexed.select(*KEY, flag.alias("fails")).join(path_sums(tree.indexed, flag, "fail_cum"), KEY)


def _starts(start) -> Column | None:
    if start is None:
        return None
    return F.expr(start) if isinstance(start, str) else start if isinstance(start, Column) else F.col("node_id").isin(list(start) if isinstance(start, (list, tuple, set)) else [start])


@navigating
def descendants(tree, key=None, start=None, scale=None, symbol=None, link=None, where=None, all: bool = True, self: bool = False, recursivity_level: int | None = None, ignore_nothing: bool = False) -> DataFrame:
    """(tree_id, start_id, node_id, dist, tin, keys...): the nodes below each start node that pass; ``tin`` is their order.

    ``all=False`` drops what lies below a node that fails. ``recursivity_level`` limits the depth, whatever the filters do;
    with ``self`` the start node is one level. ``ignore_nothing`` joins the filter for one key and
    drops rows with a null for several.
    """
    keys = _keys(key)
    filt = Filter(scale, symbol, link, where)
    passes = filt.column()
    if ignore_nothing and len(keys) == 1:
        passes = passes & F.col(keys[0]).isNotNull()
    marked = tree.indexed.withColumn("_passes", passes)
    carried = ["tin", *[k for k in keys if k not in ("tin", *KEY)], "_passes"]
    prunes = not all and not (filt.empty and not ignore_nothing)
    most = recursivity_level - (1 if self else 0) if recursivity_level is not None and recursivity_level >= 0 else None
    if isinstance(start, int) and tree.strategy != "closure":
        # one start node: a range of pre-order numbers, read off the index
        top = tree.indexed.where(F.col("node_id") == start).select("tree_id", F.col("node_id").alias("anc_id"), F.col("tin").alias("_low"), F.col("tout").alias("_high"), F.col("depth").alias("_depth"))
        rows = marked.join(top, "tree_id").where("tin between _low and _high")  # one row for each tree that has the id
        rows = rows.select("tree_id", "anc_id", "node_id", (F.col("depth") - F.col("_depth")).cast("int").alias("dist"), *carried).where(F.col("dist") >= (0 if self else 1))
        rows = rows if most is None else rows.where(F.col("dist") <= most)
    else:
        tops = tree.indexed if start is None else tree.indexed.where(_starts(start))
        rows = tree.pairs(tops, marked if prunes else marked.where("_passes"), self, lower=carried, most=most)
    if prunes:
        fails = _failures(tree, passes)
        above = fails.select("tree_id", F.col("node_id").alias("anc_id"), (F.col("fail_cum") - (F.col("fails") if self else F.lit(0))).alias("_base"))
        rows = rows.join(fails.select(*KEY, "fail_cum"), KEY).join(above, ["tree_id", "anc_id"]).where("fail_cum = _base")
    rows = rows.where("_passes")
    if ignore_nothing and len(keys) > 1:
        rows = rows.dropna("any", subset=keys)
    return rows.select("tree_id", F.col("anc_id").alias("start_id"), "node_id", "dist", "tin", *[k for k in keys if k not in ("tin", *KEY)])


@navigating
def ancestors(tree, key=None, start=None, scale=None, symbol=None, link=None, where=None, all: bool = True, self: bool = False, recursivity_level: int | None = None, ignore_nothing: bool = False) -> DataFrame:
    """(tree_id, start_id, node_id, dist, keys...): the nodes above each start node that pass, nearest first by ``dist``.

    ``recursivity_level`` counts the nodes that are kept, the start node not; without filters and with ``ignore_nothing``
    it counts steps. ``all=False`` ends the way up at the first node that fails.
    """
    keys = _keys(key)
    filt = Filter(scale, symbol, link, where)
    passes = filt.column()
    limit = recursivity_level if recursivity_level is not None and recursivity_level >= 0 else None
    hops = limit is not None and filt.empty and all and ignore_nothing and len(keys) == 1
    if ignore_nothing and len(keys) == 1:
        passes = passes & F.col(keys[0]).isNotNull()
    prunes = not all and not (filt.empty and not ignore_nothing)
    up = tree.indexed.withColumn("_passes", passes)
    low = tree.indexed if start is None else tree.indexed.where(_starts(start))
    rows = tree.pairs(up if prunes else up.where("_passes"), low, self, upper=["_passes", *[k for k in keys if k not in KEY]], most=limit if hops else None)
    if prunes:
        fails = _failures(tree, passes)
        own = fails.select(*KEY, (F.col("fail_cum") - (F.lit(0) if self else F.col("fails"))).alias("_own"))
        above = fails.select("tree_id", F.col("node_id").alias("anc_id"), (F.col("fail_cum") - F.col("fails")).alias("_base"))
        rows = rows.join(own, KEY).join(above, ["tree_id", "anc_id"]).where("_own = _base")
    rows = rows.where("_passes")
    if limit is not None and not hops:
        place = F.sum(F.when(F.col("dist") > 0, 1).otherwise(0)).over(Window.partitionBy(*KEY).orderBy("dist"))
        rows = rows.withColumn("_n", place).where(F.col("_n") <= limit)
    if ignore_nothing and len(keys) > 1:
        rows = rows.dropna("any", subset=keys)
    return rows.select("tree_id", F.col("node_id").alias("start_id"), F.col("anc_id").alias("node_id"), "dist", *[k for k in keys if k not in KEY])


def values(rows: DataFrame, key: str, order: str = "tin") -> DataFrame:
    """One array of the key per start node, in order."""
    lists = rows.groupBy("tree_id", "start_id").agg(F.array_sort(F.collect_list(F.struct(order, "node_id", F.col(key).alias("_v")))).alias("_l"))
    return lists.select("tree_id", "start_id", F.transform("_l", lambda x: x["_v"]).alias(key))


def traverse(tree, *results: Column | str, start=None, scale=None, symbol=None, link=None, where=None, all: bool = True, recursivity_level: int | None = None) -> DataFrame:
    """The nodes of the trees, or of the subtrees of ``start``, in pre-order by ``tin``, with the given results."""
    roots = "parent_id is null" if start is None else start
    found = descendants(tree, None, roots, scale, symbol, link, where, all, True, recursivity_level)
    return tree.indexed.join(found.select(*KEY, "start_id"), KEY).select("tree_id", "start_id", "node_id", "tin", *results)


def list_nodes(tree) -> DataFrame:
    return tree.indexed.select(*KEY, "tin")


def post_order(tree) -> DataFrame:
    """Every node with its place in post-order: after all that end before it, deeper nodes of one path first."""
    below = F.col("size") - 1
    return tree.indexed.select(*KEY, (F.col("tin") - F.col("depth") + below).cast("bigint").alias("tpost"))


def leaves(tree) -> DataFrame:
    return tree.indexed.where("is_leaf").select(*KEY, "tin")


def get_descendant(tree, places: list[int], start="parent_id is null") -> DataFrame:
    """From each start node down by child numbers (from 1)."""
    at = tree.indexed.where(_starts(start)).select("tree_id", F.col("node_id").alias("start_id"), "node_id")
    for place in places:
        below = children(tree, place).select("tree_id", "node_id", "child_id")
        at = at.join(below, KEY).select("tree_id", "start_id", F.col("child_id").alias("node_id"))
    return at


class NodeCache:
    """Filtered node tables and value lists that are kept for reuse, by filter; one for each immutable tree.

    ``traverse`` and ``descendants`` of the cache give what the functions of these names give, from what is kept where the filter is the same.
    """

    def __init__(self, tree):
        self.tree, self.kept = tree, {}
        self.asked = {}  # by name; functions are named by their addresses, so they have to live as long as what is kept under these

    @staticmethod
    def name(*parts) -> str:
        return "_cache_" + hashlib.sha1(repr(parts).encode()).hexdigest()

    def _keep(self, name: str, rows: DataFrame, overwrite: bool, *parts) -> DataFrame:
        if name in self.kept:
            if not overwrite:
                raise ValueError("this is cached already; use overwrite=True")
            self.kept.pop(name).unpersist()
        self.kept[name], self.asked[name] = rows.persist(), parts
        return self.kept[name]

    def cache_nodes(self, scale=None, symbol=None, link=None, where=None, all: bool = True, overwrite: bool = False) -> DataFrame:
        rows = traverse(self.tree, *self.tree.nodes.columns[2:], scale=scale, symbol=symbol, link=link, where=where, all=all).orderBy("tree_id", "tin")
        return self._keep(self.name(scale, symbol, link, where, all), rows, overwrite, where)

    def nodes(self, scale=None, symbol=None, link=None, where=None, all: bool = True) -> DataFrame | None:
        return self.kept.get(self.name(scale, symbol, link, where, all))

    def traverse(self, *results: Column | str, **filters) -> DataFrame:
        """The nodes of the whole trees that pass, with the given results over their columns; rows come by tree and in pre-order."""
        kept = self.nodes(**filters)
        return traverse(self.tree, *results, **filters).orderBy("tree_id", "tin") if kept is None else kept.select("tree_id", "start_id", "node_id", "tin", *results)

    def cache_values(self, key: str, overwrite: bool = False, **options) -> DataFrame:
        """The list of an attribute below every node."""
        return self._keep(self.name("values", key, sorted(options.items())), values(descendants(self.tree, key, **options), key), overwrite, options)

    def descendants(self, key: str, **options) -> DataFrame:
        kept = self.kept.get(self.name("values", key, sorted(options.items())))
        return values(descendants(self.tree, key, **options), key) if kept is None else kept

    def clean_cache(self) -> list[str]:
        gone = list(self.kept)
        for name in gone:
            self.kept.pop(name).unpersist()
        self.asked.clear()
        return gone
