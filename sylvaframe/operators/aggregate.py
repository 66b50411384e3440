"""Tree statistics: aggregates over subtrees and root paths, leaf counts, branching order, pipe models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import packed
from .filters import Filter, navigating
from .index import KEY, along, last_before, merged, path_sums, pools, range_agg, rollups, subtree_sums, sum_before


def _from(tree, start) -> DataFrame:
    from .query import _starts

    return tree.indexed if start is None else tree.indexed.where(_starts(start))


@navigating
def subtree_agg(tree, start=None, self: bool = False, scale=None, symbol=None, link=None, where=None, **aggregates: Column) -> DataFrame:
    """One row per start node with aggregates over the columns of the nodes below it.

    A node's row goes to each node of its path and is aggregated before the shuffle. Start nodes
    without passing nodes have no row.
    """
    columns = [c for c in tree.nodes.columns if c not in KEY]
    rows = tree.pairs(_from(tree, start), tree.indexed.where(Filter(scale, symbol, link, where).column()), self, lower=columns)
    return rows.groupBy("tree_id", F.col("anc_id").alias("start_id")).agg(*[a.alias(n) for n, a in aggregates.items()])


@navigating
def path_agg(tree, start=None, self: bool = False, scale=None, symbol=None, link=None, where=None, **aggregates: Column) -> DataFrame:
    """One row per start node with aggregates over the columns of the nodes above it."""
    columns = [c for c in tree.nodes.columns if c not in KEY]
    rows = tree.pairs(tree.indexed.where(Filter(scale, symbol, link, where).column()), _from(tree, start), self, upper=columns)
    return rows.groupBy("tree_id", F.col("node_id").alias("start_id")).agg(*[a.alias(n) for n, a in aggregates.items()])


_WHOLE = ("tinyint", "smallint", "int", "bigint", "decimal")
_FRACTIONAL = ("float", "double")


@navigating
def subtree_totals(tree, self: bool = False, scale=None, symbol=None, link=None, where=None, **columns: str) -> DataFrame:
    """``start_id``, ``n``, the number of passing nodes below each node, and by name the sums of numeric columns over
    them (null where none has a value). Start nodes without passing nodes have no row.

    The result of ``subtree_agg`` with counts and sums, however deep the trees. Whole numbers and decimals are differences of running sums over the
    pre-order, which are exact; floating-point numbers are summed from the leaves up, as differences of them would lose digits.
    """
    kinds = dict(tree.nodes.dtypes)
    if odd := [c for c in columns.values() if not kinds[c].startswith(_WHOLE + _FRACTIONAL)]:
        raise TypeError(f"only numbers can be summed, not {', '.join(odd)}")
    exact = {k: c for k, c in columns.items() if kinds[c].startswith(_WHOLE)}
    passes = Filter(scale, symbol, link, where).column()
    rows = tree.indexed.withColumn("_passes", passes)
    values = {k: F.when(F.col("_passes"), F.col(c)) for k, c in exact.items()}
    wanted = [(F.col("_passes").cast("int"), "n"), *[p for k, v in values.items() for p in ((F.coalesce(v, F.lit(0)), k), (v.isNotNull().cast("int"), f"_has_{k}"))]]
    whole = subtree_sums(rows, *[x for pair in wanted for x in pair])
    if not self:
        own = rows.select(*KEY, *[v.alias(f"_own_{n}") for v, n in wanted])
        whole = whole.join(own, KEY).select(*KEY, *[(F.col(n) - F.col(f"_own_{n}")).alias(n) for _, n in wanted])
    sums = whole.where("n > 0").select("tree_id", F.col("node_id").alias("start_id"), "n", *[F.when(F.col(f"_has_{k}") > 0, F.col(k)).alias(k) for k in exact])
    rest = {k: ("sum", c) for k, c in columns.items() if k not in exact}
    if rest:
        sums = sums.join(subtree_ranges(tree, None, self, scale, symbol, link, where, **rest), ["tree_id", "start_id"], "left")
    return sums.select("tree_id", "start_id", "n", *columns)


_MERGED = {"max": F.max, "min": F.min, "sum": F.sum}


@navigating
def subtree_ranges(tree, start=None, self: bool = False, scale=None, symbol=None, link=None, where=None, **aggregates: tuple[str, str]) -> DataFrame:
    """One row per start node with aggregates over the passing nodes below it, without a row for each of these: ``name=("max" | "min" | "sum" | "distinct", column)``.

    In pre-order the nodes below are a range, which is put together from aligned blocks. ``distinct`` counts the different values that are not null: occurrences less
    the pairs of neighbouring occurrences of one value, each pair counted at its lowest common ancestor. Start nodes without passing nodes have no row.
    """
    rolled = _rolled(tree, start, self, Filter(scale, symbol, link, where).column(), aggregates)
    if rolled is not None:
        return rolled
    passing = tree.indexed.where(Filter(scale, symbol, link, where).column())
    starts = _from(tree, start).select(*KEY, (F.col("tin") + (0 if self else 1)).alias("low"), F.col("tout").alias("high")).where("low <= high")
    folds = {n: (_MERGED[kind], c) for n, (kind, c) in aggregates.items() if kind != "distinct"}
    rows = passing.select("tree_id", "tin", *{c for _, c in folds.values()})
    out = range_agg(starts, KEY, rows, tree.largest, _passing=(F.max, F.lit(1)), **folds)
    for name, (kind, column) in aggregates.items():
        if kind == "distinct":
            out = out.join(_distinct(tree, passing, column, name, self), KEY)
    return out.select("tree_id", F.col("node_id").alias("start_id"), *aggregates)


#: Different values of a column whose presence is kept in the bits of numbers, so many to each.
MOST_BITS, BITS = 252, 63
_ROLLED = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "double": "double"}


def _rolled(tree, start, own: bool, passes: Column, aggregates: dict) -> DataFrame | None:
    """``subtree_ranges`` from the leaves up, where all that is asked are largest and least numbers, sums of doubles and counts of different values that are few; else None."""
    kinds = dict(tree.indexed.dtypes)
    if any(kind == "sum" and kinds[c] != "double" or kind != "distinct" and kinds[c] not in _ROLLED for kind, c in aggregates.values()):
        return None
    passing = tree.indexed.where(passes)
    asked, back, columns = {"_passing": ("max", "_passing")}, [], {"_passing": F.lit(1).cast("bigint")}
    for name, (kind, c) in aggregates.items():
        if kind != "distinct":
            asked[name], columns[f"_v_{name}"] = (kind, f"_v_{name}"), F.col(c).cast(_ROLLED[kinds[c]])
            back.append(F.col(name).cast(kinds[c]).alias(name))
            continue
        if kinds[c] not in ("string", "boolean", "date") and kinds[c] not in _ROLLED or kinds[c] == "double":
            return None
        values = [r[0] for r in passing.where(F.col(c).isNotNull()).select(c).distinct().limit(MOST_BITS + 1).collect()]
        if len(values) > MOST_BITS:
            return None
        parts = []
        for i in range(0, max(len(values), 1), BITS):
            bit = F.create_map(*[x for j, v in enumerate(values[i : i + BITS]) for x in (F.lit(v).cast(kinds[c]), F.lit(1 << j).cast("bigint"))])[F.col(c)] if values[i : i + BITS] else F.lit(None).cast("bigint")
            asked[f"_{name}_{i}"], columns[f"_v_{name}_{i}"] = ("or", f"_v_{name}_{i}"), F.coalesce(bit, F.lit(0).cast("bigint"))
            parts.append(F.bit_count(f"_{name}_{i}").cast("bigint"))
        back.append(sum(parts[1:], parts[0]).alias(name))
    rows = passing.select(*KEY, "parent_id", "is_leaf", *[c.alias(n) for n, c in columns.items()])
    found = rollups(tree.indexed, rows, **asked)
    if found is None:
        return None
    if own:
        mine = rows.select(*KEY, *[F.col(c).alias(f"_own_{n}") for n, (_, c) in asked.items()])
        found = found.join(mine, KEY, "full")
        found = found.select(*KEY, *[merged(k, n, f"_own_{n}").alias(n) for n, (k, _) in asked.items()])
    found = found.where("_passing is not null")
    if start is not None:
        found = found.join(_from(tree, start).select(*KEY), KEY)
    return found.select("tree_id", F.col("node_id").alias("start_id"), *back)


def _distinct(tree, passing: DataFrame, column: str, name: str, own: bool) -> DataFrame:
    """``tree_id, node_id`` and the number of different values of a column over the passing nodes in the subtree (``own``: the node itself is one)."""
    seen = passing.where(F.col(column).isNotNull()).select(*KEY, "tin", F.col(column).alias("_v"), F.struct("tin", "node_id").alias("_me"))
    before = packed(last_before(seen, ["tree_id", "_v"], "tin", "_me", "_last").where("_last is not null").select("tree_id", "node_id", F.col("_last.node_id").alias("_last_id"), (F.col("_last.tin") + 1).alias("low"), F.col("tin").alias("high")), "neighbours")
    # the highest node that begins after the first and not after the second is a child of their lowest common ancestor
    top = F.struct("depth", F.col("parent_id").alias("id"))
    ancestor = range_agg(before, ["node_id", "_last_id"], tree.indexed, tree.largest, _top=(F.min, top)).where("_top.id is not null")
    marks = ancestor.groupBy("tree_id", F.col("_top.id").alias("node_id")).agg(F.count(F.lit(1)).alias("_pairs"), F.count(F.when(F.col("_last_id") == F.col("_top.id"), 1)).alias("_mine"))
    rows = tree.indexed.select(*KEY, "tin", "tout").join(seen.select(*KEY, F.lit(1).alias("_one")), KEY, "left").join(marks, KEY, "left").na.fill(0, ["_one", "_pairs", "_mine"])
    summed = subtree_sums(rows, F.col("_one"), "_ones", F.col("_pairs"), "_all").join(rows.select(*KEY, "_one", "_mine"), KEY)
    count = F.col("_ones") - F.col("_all")
    return summed.select(*KEY, (count if own else count - F.col("_one") + F.col("_mine")).cast("bigint").alias(name))


def subtree_size(tree) -> DataFrame:
    return tree.indexed.select(*KEY, F.col("size").alias("n_nodes"))


def leaf_count(tree) -> DataFrame:
    """Leaves strictly below each node."""
    rows = tree.indexed
    leaf = F.col("is_leaf") & F.col("parent_id").isNotNull()
    rolled = rollups(rows, rows.where(leaf).select(*KEY, "parent_id", "is_leaf", F.lit(1).cast("bigint").alias("_one")), _leaves=("sum", "_one"))
    if rolled is not None:
        return rolled.select(*KEY, F.coalesce("_leaves", F.lit(0).cast("bigint")).alias("n_leaves")).union(rows.where(leaf).select(*KEY, F.lit(0).cast("bigint")))
    found = subtree_sums(rows, F.col("is_leaf").cast("int"), "_leaves")
    return rows.select(*KEY, "is_leaf").join(found, KEY).select(*KEY, (F.col("_leaves") - F.col("is_leaf").cast("bigint")).alias("n_leaves"))


def nleaves(tree) -> DataFrame:
    """Leaves strictly below each node, plus one: a leaf has 1, a node with two leaves 3."""
    return leaf_count(tree).select(*KEY, (F.col("n_leaves") + 1).alias("nleaves"))


def nleaves_siblings(tree) -> DataFrame:
    """``siblings_nleaves``: the leaf counts of the siblings in child order (0 alone if there are none), and their sum."""
    rows = tree.nodes.select(*KEY, "parent_id", "child_ord").join(nleaves(tree), KEY)
    kin = rows.groupBy("tree_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("child_ord", "node_id", "nleaves"))).alias("_kin"))
    other = F.transform(F.filter("_kin", lambda x: x.node_id != F.col("node_id")), lambda x: x.nleaves)
    none = F.array(F.lit(0).cast("bigint"))
    out = rows.where("parent_id is not null").join(kin, ["tree_id", "parent_id"]).select(*KEY, F.when(F.size(other) > 0, other).otherwise(none).alias("siblings_nleaves"))
    out = out.union(rows.where("parent_id is null").select(*KEY, none))
    return out.withColumn("sum_siblings", F.aggregate("siblings_nleaves", F.lit(0).cast("bigint"), lambda a, x: a + x))


def sum_siblings(tree) -> DataFrame:
    """``sum_siblings``: the sum of the leaf counts of the siblings, without their list: the parent's total minus the own count."""
    rows = tree.nodes.select(*KEY, "parent_id").join(nleaves(tree), KEY)
    total = rows.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.sum("nleaves").alias("_total"))
    return rows.join(total, ["tree_id", "parent_id"], "left").select(*KEY, F.coalesce(F.col("_total") - F.col("nleaves"), F.lit(0)).cast("bigint").alias("sum_siblings"))


def branching_order(tree, ascend: bool = True) -> DataFrame:
    """``branching_order``: from the root (1, one more behind every "+"), or from the leaves (1, the
    largest of the children, one more at an inner node whose own link is "+")."""
    rows = tree.indexed
    if ascend:
        plus = F.when((F.col("link") == "+") & F.col("parent_id").isNotNull(), 1).otherwise(0)
        return path_sums(rows, plus, "_n").select(*KEY, (1 + F.col("_n")).cast("int").alias("branching_order"))
    # P: inner nodes linked by "+" on the path. It never falls on the way down, so the largest of the leaves below is that of the inner nodes
    inner = F.when((F.col("link") == "+") & ~F.col("is_leaf"), 1).otherwise(0)
    above = rows.where("not is_leaf")
    marked = packed(above.select(*KEY, "parent_id", "is_leaf", "tin", "tout", inner.alias("_own")).join(path_sums(above, inner, "_P"), KEY), "plus")
    deepest = rollups(rows, marked, _most=("max", "_P"))
    if deepest is None:
        deepest = range_agg(marked.where("tin < tout").select(*KEY, (F.col("tin") + 1).alias("low"), F.col("tout").alias("high")), KEY, marked.select("tree_id", "tin", "_P"), tree.largest, _most=(F.max, "_P"))
    order = 1 + F.coalesce("_most", "_P") - F.col("_P") + F.col("_own")
    found = marked.join(deepest, KEY, "left").select(*KEY, order.cast("int").alias("branching_order"))
    return found.union(rows.where("is_leaf").select(*KEY, F.lit(1)))


def pipe_model(tree, root_value: float) -> DataFrame:
    """``pipe``: the root's value shared at every node in proportion to the leaf counts of the children."""
    rows = packed(tree.indexed.select(*KEY, "parent_id", "is_leaf", "tin", "size", "depth").join(nleaves(tree), KEY), "leaf-counts")
    every = rows.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.sum("nleaves").alias("_all"))
    root = F.col("parent_id").isNull()
    shares = rows.join(every, ["tree_id", "parent_id"], "left").select(
        *KEY, F.col("parent_id").alias("jump"), "is_leaf", "tin", "size", "depth", F.when(root, 2).otherwise(0).alias("kind"), (F.col("nleaves") / F.col("_all")).alias("factor"), F.when(root, F.lit(float(root_value))).alias("value")
    )
    found = pools(shares)
    if found is None:
        return along(shares.select(*KEY, "jump", "is_leaf", F.when(F.col("kind") == 2, F.col("value")).otherwise(F.col("factor")).alias("pipe")), {"pipe": "product"})
    return found.withColumnRenamed("pool", "pipe")


def pipe_model_threshold(tree, variable: str, threshold: float, allow_missing: bool = False) -> DataFrame:
    """``pipe``: the measured value at the root and wherever it is above the threshold, elsewhere a share of the parent's.

    The pool of the parent is shared by leaf counts with the siblings. A sibling measured above the threshold is
    taken out of the pool first, if the pool is larger and the siblings' sum is smaller than its value.
    A null value stops the query unless ``allow_missing``.
    """
    v = F.col(variable).cast("double")
    if not allow_missing:
        v = F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"{variable} has no value in node "), F.col("node_id").cast("string"))).cast("double")).otherwise(v)
    kin = ["tree_id", "parent_id"]
    rows = tree.indexed.select(*KEY, "parent_id", "child_ord", "is_leaf", "tin", "size", "depth", v.alias("_v"), F.coalesce(v, F.lit(0.0)).alias("_val"))
    rows = packed(rows.join(nleaves(tree).withColumnRenamed("nleaves", "_n"), KEY), "measured")
    sums = rows.where("parent_id is not null").groupBy(*kin).agg(F.count(F.lit(1)).alias("_many"), F.sum("_n").alias("_all"), F.max("child_ord").alias("_last"), F.min("_val").alias("_least"))
    rows = rows.join(sums, kin, "left")
    if rows.where("_least < 0").isEmpty():  # then nothing is taken out of a pool
        root = F.col("parent_id").isNull()
        way = F.when(root | F.coalesce(F.col("_v") > threshold, F.lit(False)), 2).when(F.col("_many") == 1, 1).otherwise(0)
        shares = rows.select(*KEY, F.col("parent_id").alias("jump"), "is_leaf", "tin", "size", "depth", way.alias("kind"), (F.col("_n") / F.col("_all")).alias("factor"), F.col("_v").alias("value"))
        shares = shares.withColumn("value", F.when(F.col("kind") == 2, F.col("value")))
        if (found := pools(shares)) is not None:
            return found.withColumnRenamed("pool", "pipe")
    # where no value is negative no sum is below one of its terms; elsewhere a sum without the node is what comes before and after it
    mixed = rows.where("_least < 0").select(*KEY, "parent_id", "child_ord", (F.col("_last") - F.col("child_ord")).alias("_back"), "_val", "_n")
    mixed = sum_before(sum_before(mixed, kin, "child_ord", F.col("_val"), "_before"), kin, "_back", F.col("_val"), "_after")
    mixed = packed(mixed.withColumn("_total", F.col("_before") + F.col("_after")), "sibling-sums")
    lowest = mixed.groupBy(*kin).agg(F.min("_total").alias("_lowest"))
    takable = mixed.join(lowest, kin).where((F.col("_val") > threshold) & (F.col("_val") > F.col("_lowest")))
    takable = takable.groupBy(*kin).agg(F.array_sort(F.collect_list(F.struct("child_ord", "node_id", F.col("_val").alias("v"), F.col("_n").alias("n")))).alias("_kin"))
    local = rows.join(mixed.select(*KEY, "_total"), KEY, "left").join(takable, kin, "left").select("tree_id", F.col("node_id").alias("anc_id"), "parent_id", "_v", "_n", "_many", "_all", "_total", "_kin")
    facts = F.struct((-F.col("dist")).alias("o"), F.col("anc_id").alias("id"), F.col("parent_id").isNull().alias("root"), F.col("_v").alias("v"), F.col("_n").alias("n"), (F.col("_all") - F.col("_n")).alias("others"), (F.col("_many") == 1).alias("alone"), F.col("_total").alias("total"), F.col("_kin").alias("kin"))
    carried = [c for c in local.columns if c not in ("tree_id", "anc_id")]
    above = tree.indexed.select(*KEY, "tin", "tout", "depth", "size").join(local.withColumnRenamed("anc_id", "node_id"), KEY)
    paths = tree.pairs(above, tree.indexed, upper=carried).groupBy(*KEY).agg(F.array_sort(F.collect_list(facts)).alias("_path"))

    def step(pool, x):
        def take(state, s):
            out = (s.node_id != x.id) & (state.pool > s.v) & (x.total < s.v)
            return F.struct(F.when(out, state.pool - s.v).otherwise(state.pool).alias("pool"), F.when(out, state.others - s.n).otherwise(state.others).alias("others"))

        start = F.struct(pool.alias("pool"), x.others.alias("others"))
        taken = F.aggregate(x.kin, start, take, lambda s: s.pool * (x.n / (s.others + x.n)))
        shared = F.when(x.kin.isNull(), pool * (x.n / (x.others + x.n))).otherwise(taken)
        return F.when(x.root | F.coalesce(x.v > threshold, F.lit(False)), x.v).when(x.alone, pool).otherwise(shared)

    return paths.select(*KEY, F.aggregate("_path", F.lit(None).cast("double"), step).alias("pipe"))


def get_classes(tree) -> DataFrame:
    """The symbols with their scales in order of first appearance (``first_tin``)."""
    out = tree.indexed.groupBy("symbol", "scale").agg(F.min("tin").alias("first_tin"))
    return out.select(F.col("symbol").alias("SYMBOL"), F.col("scale").alias("SCALE"), F.lit("FREE").alias("DECOMPOSITION"), F.lit("FREE").alias("INDEXATION"), F.lit("IMPLICIT").alias("DEFINITION"), "first_tin")


_FEATURES = ((T.BooleanType, "BOOLEAN"), (T.IntegralType, "INT"), (T.FractionalType, "REAL"), (T.DateType, "DD/MM/YY"))


def feature_type(kind: T.DataType) -> str:
    return next((n for t, n in _FEATURES if isinstance(kind, t)), "STRING")


def get_features(tree) -> DataFrame:
    """(NAME, TYPE) of the attributes that have a value somewhere; arrays and maps are left out."""
    fields = [f for f in tree.nodes.schema.fields if f.name in tree.attributes and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    schema = "NAME string, TYPE string"
    if not fields:
        return tree.spark.createDataFrame([], schema)
    counts = tree.nodes.agg(*[F.count(f.name).alias(f.name) for f in fields]).head()
    return tree.spark.createDataFrame([(f.name, feature_type(f.dataType)) for f in fields if counts[f.name]], schema)


def get_description(tree) -> None:
    return None


def scales(tree) -> DataFrame:
    return tree.indexed.groupBy("scale").agg(F.min("tin").alias("first_tin"))


def symbols(tree) -> DataFrame:
    return tree.indexed.groupBy("symbol").agg(F.min("tin").alias("first_tin"))


components = symbols


def max_id(tree) -> DataFrame:
    return tree.nodes.groupBy("tree_id").agg(F.max("node_id").alias("max_id"))


def new_id(tree) -> DataFrame:
    return tree.nodes.groupBy("tree_id").agg((F.max("node_id") + 1).alias("new_id"))


def attribute_names(tree, start: int | None = None) -> list[str]:
    """Names that the symbols of the trees, or of one subtree, have."""
    rows = tree.nodes if start is None else tree.inside(start)
    found = {r.symbol for r in rows.select("symbol").distinct().collect()}
    return list(dict.fromkeys(a for s, names in tree.catalog.items() if s in found for a in names))
