"""Depth, size and pre-order of trees without a step per level or a path per node, and joins over pre-order.

Inner nodes know a node above them, their jump, at first their parent; in each round a node takes its jump's jump. So after k rounds a jump is
2^k steps long, and a tree of depth d takes about log2 d rounds of at most one row for each inner node, also where it is a chain of
millions. Trees of up to ``LOCAL`` inner nodes go through these rounds in the arrays of a task, many trees side by side; larger ones in joins. In the same rounds a node hands the number of nodes that it has counted below itself to its jump, which gives sizes, and later adds
what its jump has summed up, which gives pre-order numbers: a node comes after its parent and after the subtrees of its earlier siblings.
Leaves take part in no round. (Ranking the arcs of an Euler tour takes log2 of twice the number of nodes, however shallow the trees are.)

In pre-order a subtree is a range. Sums over it are differences of running sums; anything that merges is put together from aligned
blocks of 1, 8, 64, ... places; pairs of nodes and nodes below them come from an equi-join of ranges cut into bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, packed, stored

KEY = ["tree_id", "node_id"]
COLUMNS = ["root_id", "depth", "n_children", "is_leaf", "size", "tin", "tout"]
#: Inner nodes of the largest tree that is ranked in one task (a few numbers each), and rows that are ranked at a time.
LOCAL, CHUNK = 1 << 20, 1 << 18
#: Places of an order that one window takes at a time.
WIDTH = 1 << 16
#: Places of the narrowest bins of ``pairs``, how many times wider those of the next level are, and the bins of a range at which that is used.
BIN, WIDER, MOST_BINS = 32, 64, 512
#: Places of a block of ``range_agg`` in one of the next level.
BLOCK = 8


CYCLE = "the parents of some nodes form a cycle"


def _missing(parent: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no node with the id "), parent.cast("string")))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, path`` (ids from the root to the node), for the strategy ``closure``: as many entries as the sum of depths."""
    up = stored(nodes.select("tree_id", "node_id", F.col("parent_id").alias("jump"), F.array("node_id").alias("path")), "paths")
    total = up.count()
    rounds = 0
    while not up.where("jump is not null").isEmpty():
        rounds += 1
        if 2 ** (rounds - 1) > total:
            raise ValueError(CYCLE)
        above = up.select("tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("_next"), F.col("path").alias("_above"))
        open_, done = up.where("jump is not null"), up.where("jump is null")
        joined = open_.join(above, ["tree_id", "jump"], "left")
        path = F.when(F.col("_above").isNull(), _missing(F.col("jump")).cast("array<bigint>")).otherwise(F.concat("_above", "path"))
        up = stored(joined.select("tree_id", "node_id", F.col("_next").alias("jump"), path.alias("path")).union(done.select("tree_id", "node_id", "jump", "path")), "paths")
    return up.drop("jump")


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each different combination of values."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        found = pc.dictionary_encode(column)
        code = np.unique(code * max(len(found.dictionary), 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _ranks(tree: np.ndarray, nodes: pa.Array, jump: pa.Array) -> np.ndarray:
    """The row of each row's jump, -1 at a root, among whole trees (a number each). Raises an error on a jump to nowhere."""
    node, is_root = nodes.to_numpy(), pc.is_null(jump).to_numpy(zero_copy_only=False)
    above = pc.fill_null(jump, 0).to_numpy()
    known, code = np.unique(node, return_inverse=True)
    own = tree * len(known) + code
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(known, above), len(known) - 1)
    place = np.minimum(np.searchsorted(own[order], tree * len(known) + at), len(own) - 1)
    found = order[place]
    wrong = ~is_root & ((node[found] != above) | (tree[found] != tree))
    if wrong.any():
        raise ValueError(f"no node with the id {above[wrong][0]}")
    return np.where(is_root, -1, found)


def in_chunks(batches, keys: list[str]):
    """Tables of about ``CHUNK`` rows of batches that are sorted by keys, each of whole keys."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= CHUNK:  # up to the last key that has begun, the rows are whole
            table = pa.Table.from_batches([*held, batch])
            same = np.ones(table.num_rows, bool)
            for k in keys:
                same &= pc.fill_null(pc.equal(table.column(k), table.column(k)[-1]), False).to_numpy(zero_copy_only=False) if table.column(k)[-1].is_valid else pc.is_null(table.column(k)).to_numpy(zero_copy_only=False)
            last = int(same.argmax())
            if last:
                yield table.slice(0, last)
                held, count = table.slice(last).to_batches(), table.num_rows - last
                continue
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _by_tree(rows: DataFrame, schema: str, solve, keys: tuple[str, ...] = ("tree_id",)) -> DataFrame:
    """``solve`` for whole trees of at most ``LOCAL`` rows each, some at a time: it takes the rows, each row's jump among them and a number
    for its tree, and gives columns. Trees are told apart by ``keys``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    same = [*keys, "node_id"]

    def run(batches):
        for table in in_chunks(batches, keys):
            batch = table.combine_chunks().to_batches()[0]
            tree = _codes([batch.column(k) for k in keys])
            found = solve(batch, _ranks(tree, batch.column("node_id"), batch.column("jump")), tree)
            yield pa.RecordBatch.from_arrays([batch.column(n) if n in same else pa.array(found[n], arrow.field(n).type, from_pandas=False) for n in arrow.names], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _doubling(jump: np.ndarray, step) -> None:
    """Rounds of ``step(rows, their jumps)`` with jumps of twice the length each, until no row has one."""
    jump = jump.copy()
    for _ in range(int(len(jump)).bit_length() + 1):
        rows = np.flatnonzero(jump >= 0)
        if not len(rows):
            return
        to = jump[rows]
        step(rows, to)
        jump[rows] = jump[to]
    raise ValueError(CYCLE)


def sent(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined, sent to all tasks if they are few."""
    return F.broadcast(rows) if len(rows.select(*rows.columns[:1]).take(MOST_SENT + 1)) <= MOST_SENT else rows


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of trees of at most ``LOCAL`` rows, and those of larger ones if there are any."""
    large = rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LOCAL).select("tree_id")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "tree_id", "left_anti"), rows.join(large, "tree_id", "left_semi")


#: How values of a path are folded, for columns and for arrays.
FOLDS = {"sum": (lambda a, b: a + b, np.add), "product": (lambda a, b: a * b, np.multiply)}


def along(rows: DataFrame, folds: dict[str, str]) -> DataFrame:
    """``tree_id, node_id`` and columns folded (``sum`` or ``product``) over the path of every row, from its root down.

    ``rows`` has ``tree_id, node_id, jump`` (the parent; null at a root), ``is_leaf`` and the columns. Leaves follow their parents at the end. Trees of at most
    ``LOCAL`` inner nodes are folded in one task each; in larger ones all inner nodes double their jumps together, and each round is
    stored, so a lost executor costs one round.
    """
    names = list(folds)
    kinds = dict(rows.dtypes)
    rows = packed(rows.select(*KEY, "jump", "is_leaf", *names), "along")
    leaf = F.col("is_leaf") & F.col("jump").isNotNull()
    small, big = _split(rows.where(~leaf).select(*KEY, "jump", *names))

    def solve(batch, jump, tree):
        values = {n: batch.column(n).to_numpy(zero_copy_only=False).copy() for n in names}

        def step(at, to):
            for n, fold in folds.items():
                values[n][at] = FOLDS[fold][1](values[n][to], values[n][at])

        _doubling(jump, step)
        return values

    done = _by_tree(small, f"tree_id {kinds['tree_id']}, node_id {kinds['node_id']}, " + ", ".join(f"{n} {kinds[n]}" for n in names), solve)
    if big is not None:
        up = packed(big, "along")
        rounds, total = 0, up.count()
        while not (open_ := up.where("jump is not null")).isEmpty():
            rounds += 1
            if 2 ** (rounds - 1) > total:
                raise ValueError(CYCLE)
            above = up.select("tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("_next"), F.lit(True).alias("_there"), *[F.col(n).alias(f"_a_{n}") for n in names])
            joined = open_.join(above, ["tree_id", "jump"], "left")
            onward = F.when(F.col("_there").isNull(), _missing(F.col("jump")).cast("bigint")).otherwise(F.col("_next"))
            step = joined.select(*KEY, onward.alias("jump"), *[FOLDS[f][0](F.col(f"_a_{n}"), F.col(n)).alias(n) for n, f in folds.items()])
            last, up = up, packed(step.union(up.where("jump is null").select(step.columns)), "along")
            discard(last)
        done = done.union(up.drop("jump"))
    done = packed(done, "along")
    over = done.select("tree_id", F.col("node_id").alias("jump"), *[F.col(n).alias(f"_a_{n}") for n in names])
    under = rows.where(leaf).join(over, ["tree_id", "jump"]).select(*KEY, *[FOLDS[f][0](F.col(f"_a_{n}"), F.col(n)).alias(n) for n, f in folds.items()])
    return done.union(under)


def _shared(batch, jump: np.ndarray, tree: np.ndarray) -> dict:
    """Pools from the roots down, a level at a time."""
    of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    known = lambda c: ~pc.is_null(batch.column(c)).to_numpy(zero_copy_only=False)
    given, kind, factor, depth = of("given"), of("kind"), of("factor"), of("depth")
    pool, has = of("value").copy(), known("value")
    from_above = known("given")
    order = np.argsort(depth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        rows = rows[kind[rows] < 2]
        up = jump[rows]
        inside = up >= 0
        pool[rows] = np.where(inside, pool[up], given[rows]) * np.where(kind[rows] == 1, 1.0, factor[rows])
        has[rows] = np.where(inside, has[up], from_above[rows])
    return {"pool": np.ma.masked_array(pool, ~has)}


def pools(rows: DataFrame) -> DataFrame | None:
    """``tree_id, node_id, pool`` of nodes (tree_id, node_id, jump: the parent, is_leaf, tin, size, depth, kind, factor, value): their own value (kind 2, so at every root), the
    parent's pool (1) or that times the factor (0), multiplied from the root down in this order.

    Subtrees of at most ``LOCAL`` nodes go through arrays, those that begin in one stretch of the pre-order side by side in a task; the nodes above them come first, and
    leaves follow their parents at the end. None if the nodes above are too many for a task.
    """
    kind = dict(rows.dtypes)["tree_id"]
    schema = f"tree_id {kind}, node_id bigint, pool double"
    names = ["tree_id", "node_id", "jump", "depth", "kind", "factor", "value"]
    rows = packed(rows, "shares")
    leaf = F.col("is_leaf") & F.col("jump").isNotNull()
    inner = rows.where(~leaf)
    top = inner.where(F.col("size") > LOCAL)
    many = top.count()
    if many > LOCAL:
        discard(rows)
        return None
    none = F.lit(None).cast("double").alias("given")
    top = packed(_by_tree(top.select(*names, none), schema, _shared), "pools")
    low = _in_parts(inner, top.select(*KEY, F.col("pool").alias("given")), names)
    found = packed(_by_tree(low.select("part", *names, "given"), schema, _shared, ("tree_id", "part")).union(top), "pools")
    over = found.select("tree_id", F.col("node_id").alias("jump"), F.col("pool").alias("_pool"))
    share = F.when(F.col("kind") == 2, F.col("value")).when(F.col("kind") == 1, F.col("_pool")).otherwise(F.col("_pool") * F.col("factor"))
    return found.union(rows.where(leaf).join(over, ["tree_id", "jump"]).select(*KEY, share))


def _in_parts(inner: DataFrame, top: DataFrame, names: list[str]) -> DataFrame:
    """The inner nodes (tree_id, node_id, jump, tin, size and ``names``) of subtrees of at most ``LOCAL`` nodes, with their ``part``: subtrees that begin in one stretch of the pre-order.
    Where the parent is in ``top`` (tree_id, node_id and columns, which the row gets), ``up`` keeps it and the jump is null."""
    over = top.withColumnRenamed("node_id", "jump").withColumn("_head", F.lit(True))
    low = inner.where(F.col("size") <= LOCAL).join(sent(over), ["tree_id", "jump"], "left").withColumn("_head", F.col("jump").isNull() | F.coalesce("_head", F.lit(False)))
    jump = F.when(~F.col("_head"), F.col("jump")).alias("jump")
    low = low.select(*[jump if n == "jump" else F.col(n) for n in names], *top.columns[2:], F.when(F.col("_head"), F.col("jump")).alias("up"), "_head", "tin", F.floor(F.col("tin") / LOCAL).alias("part"), (F.col("tin") + F.col("size") - 1).alias("_until"))
    low = packed(low, "parts")
    # at most one subtree ends in a stretch that it did not begin in
    crossing = low.where(F.col("_head") & (F.floor(F.col("_until") / LOCAL) > F.col("part"))).select("tree_id", (F.col("part") + 1).alias("part"), F.col("_until").alias("_last"))
    return low.join(sent(crossing), ["tree_id", "part"], "left").withColumn("part", F.col("part") - F.coalesce((F.col("tin") <= F.col("_last")).cast("int"), F.lit(0)))


def _least(kind: str, integral: bool):
    """What changes nothing when it is merged, and the merge."""
    if kind == "max":
        return (np.iinfo(np.int64).min if integral else -np.inf), np.maximum
    if kind == "min":
        return (np.iinfo(np.int64).max if integral else np.nan), np.minimum if integral else np.fmin  # NaN is the largest number
    return 0, np.add if kind == "sum" else np.bitwise_or


def merged(kind: str, a: str, b: str) -> Column:
    """Two values of ``rollups`` in one; a null is none."""
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(a, b)
    return F.coalesce(F.expr(f"`{a}` {'+' if kind == 'sum' else '|'} `{b}`"), a, b)


def rollups(indexed: DataFrame, rows: DataFrame, **aggregates: tuple) -> DataFrame | None:
    """``tree_id, node_id`` of the inner nodes and the merged values of ``rows`` (tree_id, node_id, parent_id, is_leaf and columns of bigint or double)
    strictly below them: ``name=("max" | "min" | "or" | "sum", column)``, null where there is none.

    Leaves are merged into their parents by a group, inner nodes from the deepest level up in arrays, in parts as in ``pools``, the nodes above all parts at
    the end. None if these are too many for a task.
    """
    merges = {"max": F.max, "min": F.min, "or": F.bit_or, "sum": F.sum}
    kinds = dict(rows.dtypes)
    own = {n: f"_own_{n}" for n in aggregates}
    schema = "tree_id {}, {}node_id bigint, " + ", ".join(f"{n} {kinds[c]}" for n, (_, c) in aggregates.items())
    leaf = F.col("is_leaf") & F.col("parent_id").isNotNull()
    low = rows.where(leaf).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(*[merges[k](c).alias(n) for n, (k, c) in aggregates.items()])
    inner = indexed.where("not is_leaf or parent_id is null").select(*KEY, F.col("parent_id").alias("jump"), "depth", "tin", "size")
    inner = packed(inner.join(low, KEY, "left").join(rows.where(~leaf).select(*KEY, *[F.col(c).alias(own[n]) for n, (_, c) in aggregates.items()]), KEY, "left"), "values")
    names = ["tree_id", "node_id", "jump", "depth", *aggregates, *own.values()]
    top = inner.where(F.col("size") > LOCAL)
    if top.count() > LOCAL:
        discard(inner)
        return None

    def solve(batch, jump, tree):
        depth = batch.column("depth").to_numpy()
        order = np.argsort(-depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        out = {}
        for n, (kind, c) in aggregates.items():
            least, merge = _least(kind, kinds[c] == "bigint")

            def read(name):
                there = ~pc.is_null(batch.column(name)).to_numpy(zero_copy_only=False)
                return np.where(there, pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False), least), there

            (value, has), (mine, mine_has) = read(n), read(own[n])
            for at in levels:
                at = at[jump[at] >= 0]
                merge.at(value, jump[at], merge(value[at], mine[at]))
                np.logical_or.at(has, jump[at], has[at] | mine_has[at])
            out[n] = np.ma.masked_array(value, ~has)
        return out

    kind = dict(indexed.dtypes)["tree_id"]
    parts = _in_parts(inner, top.select(*KEY), names)
    heads = packed(parts.where("up is not null").select("tree_id", "part", "node_id", "up", *own.values()), "heads")
    found = packed(_by_tree(parts.select("part", *names), schema.format(kind, "part bigint, "), solve, ("tree_id", "part")), "rolled")
    met = heads.join(found.drop("part"), KEY)
    sums = met.select("tree_id", F.col("up").alias("node_id"), *[merged(k, n, own[n]).alias(f"_more_{n}") for n, (k, _) in aggregates.items()])
    sums = sums.groupBy(*KEY).agg(*[merges[k](f"_more_{n}").alias(f"_more_{n}") for n, (k, _) in aggregates.items()])
    top = top.join(sums, KEY, "left").withColumns({n: merged(k, n, f"_more_{n}") for n, (k, _) in aggregates.items()})
    return found.drop("part").union(_by_tree(top.select(*names), schema.format(kind, ""), solve))


def sum_before(rows: DataFrame, keys: list[str], order: str, value, name: str, *more) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys that come before by ``order``; ``more`` are further pairs of value and name.

    Stretches of ``WIDTH`` places are summed on their own and then follow each other, so that a parent with very many children,
    or one giant tree, is no single task.
    """
    pairs = [(value, name), *zip(more[::2], more[1::2])]
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / WIDTH))
    sums = rows.groupBy(*keys, "_stretch").agg(*[F.sum(v).alias(f"_sum_{n}") for v, n in pairs])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_stretch", *[F.sum(f"_sum_{n}").over(before).alias(f"_start_{n}") for _, n in pairs]).where("_stretch > 0")
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order, "node_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.sum(v).over(inside) for v, n in pairs}).join(starts, [*keys, "_stretch"], "left")
    zero = F.lit(0).cast("bigint")
    return summed.withColumns({n: F.coalesce(n, zero) + F.coalesce(f"_start_{n}", zero) for _, n in pairs}).drop("_stretch", *[f"_start_{n}" for _, n in pairs])


def path_sums(indexed: DataFrame, value, name: str) -> DataFrame:
    """``tree_id, node_id`` and the sum of ``value``, a whole number, over the node's path, itself included.

    In pre-order every node opens with its value and closes with the opposite behind its subtree; what is open before a node
    is the sum of its ancestors. That takes two rows for each inner node; leaves add theirs to the sums of their parents.
    """
    rows = indexed.select(*KEY, "parent_id", "is_leaf", "tin", "tout", value.cast("bigint").alias("_value"))
    leaf = F.col("is_leaf") & F.col("parent_id").isNotNull()
    inner = rows.where(~leaf)
    opens = inner.select(*KEY, (F.col("tin") * 2).alias("_at"), "_value")
    closes = inner.where("_value <> 0").select(*KEY, (F.col("tout") * 2 + 1).alias("_at"), (-F.col("_value")).alias("_value"))
    summed = sum_before(opens.union(closes), ["tree_id"], "_at", F.col("_value"), "_open")
    summed = summed.where("_at % 2 = 0").select(*KEY, (F.col("_open") + F.col("_value")).alias(name))
    over = summed.select("tree_id", F.col("node_id").alias("parent_id"), F.col(name).alias("_over"))
    return summed.union(rows.where(leaf).join(over, ["tree_id", "parent_id"], "left").select(*KEY, F.coalesce("_over", F.lit(0).cast("bigint")) + F.col("_value")))


def subtree_sums(indexed: DataFrame, value, name: str, *more) -> DataFrame:
    """``tree_id, node_id`` and the sum of ``value``, whole numbers or decimals, over the node's subtree, itself included; ``more`` are
    further pairs of value and name.

    In pre-order a subtree is a range, so its sum is the running sum through its end less that before its beginning: one running sum for all
    values and one look-up for each inner node.
    """
    pairs = [(value, name), *zip(more[::2], more[1::2])]
    names = [n for _, n in pairs]
    rows = indexed.select(*KEY, "tin", "tout", *[F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for v, n in pairs])
    rows = rows.select(*KEY, "tin", "tout", *[F.col(f"_v_{n}").cast("bigint" if dict(rows.dtypes)[f"_v_{n}"] in ("int", "smallint", "tinyint", "boolean") else dict(rows.dtypes)[f"_v_{n}"]).alias(f"_v_{n}") for n in names])
    run = sum_before(rows, ["tree_id"], "tin", F.col(f"_v_{names[0]}"), names[0], *[x for n in names[1:] for x in (F.col(f"_v_{n}"), n)])
    ends = run.select("tree_id", F.col("tin").alias("tout"), *[(F.col(n) + F.col(f"_v_{n}")).alias(f"_end_{n}") for n in names])
    inner = run.where("tin < tout").join(ends, ["tree_id", "tout"]).select(*KEY, *[(F.col(f"_end_{n}") - F.col(n)).alias(n) for n in names])
    return inner.union(run.where("tin = tout").select(*KEY, *[F.col(f"_v_{n}").alias(n) for n in names]))


def last_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the last value that is not null of the rows of the same keys that come before by ``order``, in stretches as ``sum_before``."""
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / WIDTH))
    lasts = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_stretch").agg(F.max_by(value, order).alias("_last"))
    held = rows.select(*keys, "_stretch").distinct().join(lasts, [*keys, "_stretch"], "left")
    start = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(*keys, "_stretch", start.alias("_start"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, inside).join(starts, [*keys, "_stretch"], "left").withColumn(name, F.coalesce(name, "_start")).drop("_stretch", "_start")


def pairs(above: DataFrame, below: DataFrame, largest: int, own: bool, upper: list[str] = (), lower: list[str] = (), most: int | None = None) -> DataFrame:
    """A structural join: ``tree_id, anc_id, node_id, dist`` of every row of ``above`` and each row of ``below`` in its subtree, with
    columns of both (``upper``, ``lower``). ``own`` keeps a node as its own pair, ``most`` is the greatest distance.

    Both sides are rows of the index; ``largest`` is the size of the largest subtree. A range of pre-order numbers is cut into bins, wider ones for larger ranges, at most ``MOST_BINS``;
    a node lies in one bin of each width. Bin by bin an equi-join meets the range's bounds, so only pairs that are results leave it.
    """
    levels = 1
    while largest > BIN * MOST_BINS * WIDER ** (levels - 1):
        levels += 1
    wide = [BIN * WIDER**k for k in range(levels)]
    ranges = above.select("tree_id", F.col("node_id").alias("anc_id"), "tin", "tout", "depth", "size", *upper)
    if not own:
        ranges = ranges.where("size > 1")
    level = F.lit(0)
    for k in range(1, levels):
        level = level + (F.col("size") > BIN * MOST_BINS * WIDER ** (k - 1)).cast("int")
    at = F.element_at(F.lit(wide), F.col("_level") + 1)
    ranges = ranges.withColumn("_level", level).select(
        "tree_id", "anc_id", "_level", F.explode(F.sequence(F.floor(F.col("tin") / at), F.floor(F.col("tout") / at))).alias("_bin"), F.col("tin").alias("_low"), F.col("tout").alias("_high"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_u_{c}") for c in upper]
    )
    nodes = below.select(*KEY, "tin", "depth", *[F.col(c).alias(f"_l_{c}") for c in lower]).withColumn("_level", F.explode(F.lit(list(range(levels)))) if levels > 1 else F.lit(0)).withColumn("_bin", F.floor(F.col("tin") / at))
    inside = (F.col("tin") >= F.col("_low")) if own else (F.col("tin") > F.col("_low"))
    on = [F.col(f"r.{c}") == F.col(f"n.{c}") for c in ("tree_id", "_level", "_bin")]
    on += [inside, F.col("tin") <= F.col("_high")]
    if most is not None:
        on.append(F.col("n.depth") - F.col("_depth") <= most)
    both = ranges.alias("r").join(nodes.alias("n"), on)
    return both.select("n.tree_id", "anc_id", "node_id", (F.col("n.depth") - F.col("_depth")).cast("int").alias("dist"), *[F.col(f"_u_{c}").alias(c) for c in upper], *[F.col(f"_l_{c}").alias(c) for c in lower])


def closure(indexed: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The pairs of every node and each node on its path (of ``paths``), with columns of the lower node."""
    rows = indexed.select(*KEY, "depth", *columns).join(found, KEY)
    return rows.select("tree_id", "node_id", *columns, "depth", F.posexplode("path").alias("_pos", "anc_id")).select("tree_id", "anc_id", "node_id", (F.col("depth") - F.col("_pos")).cast("int").alias("dist"), *columns)


def range_agg(ranges: DataFrame, keys: list[str], rows: DataFrame, largest: int, **aggregates: tuple) -> DataFrame:
    """Aggregates over ranges of places: ``keys`` of ``ranges`` (tree_id, low, high and the keys) and the aggregates over the rows (tree_id, tin and columns) from low to high.

    An aggregate is a pair of a function that also merges its own results (``F.max``, ``F.min``, ``F.sum``) and a column or Column.
    A range is put together from the fewest aligned blocks of 1, 8, 64, ... places, at most 14 of each size, so its cost grows with the logarithm of
    its length. Ranges without rows have no row.
    """
    levels = 1
    while BLOCK**levels < max(largest, 2):
        levels += 1
    names = list(aggregates)
    firsts = [fn(F.col(c) if isinstance(c, str) else c).alias(n) for n, (fn, c) in aggregates.items()]
    merges = [fn(F.col(n)).alias(n) for n, (fn, _) in aggregates.items()]
    lowest = rows.select("tree_id", F.lit(0).alias("_level"), F.col("tin").alias("_block"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, (_, c) in aggregates.items()])
    if levels > 1:
        eight = packed(rows.groupBy("tree_id", F.floor(F.col("tin") / BLOCK).alias("_block")).agg(*firsts), "blocks")
        higher = eight.withColumn("_level", F.explode(F.lit(list(range(1, levels)))))
        power = F.element_at(F.lit([BLOCK ** (k - 1) for k in range(1, levels)]), F.col("_level"))
        blocks = lowest.unionByName(higher.groupBy("tree_id", "_level", F.floor(F.col("_block") / power).alias("_block")).agg(*merges))
    else:
        blocks = lowest
    none = F.array().cast("array<struct<_level:int,_block:bigint>>")

    def stretch(level, low, high):
        every = F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(level.cast("int").alias("_level"), b.cast("bigint").alias("_block")))
        return F.when(low <= high, every).otherwise(none)

    def cut(state, level):
        low, high = state["low"], state["high"]
        up_low, up_high = F.ceil(low / BLOCK).cast("bigint"), F.floor((high + 1) / BLOCK).cast("bigint")
        goes_on = (up_low < up_high) & (level < levels - 1)
        edges = F.concat(stretch(level, low, up_low * BLOCK - 1), stretch(level, up_high * BLOCK, high))
        taken = F.when(low > high, none).when(goes_on, edges).otherwise(stretch(level, low, high))
        return F.struct(F.when(goes_on, up_low).otherwise(F.lit(1)).cast("bigint").alias("low"), F.when(goes_on, up_high - 1).otherwise(F.lit(0)).cast("bigint").alias("high"), F.concat(state["pieces"], taken).alias("pieces"))

    start = F.struct(F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), none.alias("pieces"))
    pieces = F.aggregate(F.lit(list(range(levels))), start, cut, lambda s: s["pieces"])
    asked = ranges.select("tree_id", *[k for k in keys if k != "tree_id"], F.explode(pieces).alias("_p")).select("tree_id", *[k for k in keys if k != "tree_id"], "_p._level", "_p._block")
    return asked.join(blocks, ["tree_id", "_level", "_block"]).groupBy(*dict.fromkeys(["tree_id", *keys])).agg(*merges).select(*dict.fromkeys(["tree_id", *keys]), *names)


def _placed(size: np.ndarray, rank: np.ndarray, jump: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How far every node stands behind its parent: its rank among its siblings and what the earlier ones have below them."""
    kin = np.where(jump < 0, -1 - tree, jump)
    order = np.lexsort((rank, kin))
    more = (size - 1)[order]
    before = np.cumsum(more) - more
    new = np.append(True, kin[order][1:] != kin[order][:-1])
    before -= before[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty_like(size)
    out[order] = before
    return out + rank


def _solve(batch, jump: np.ndarray, tree: np.ndarray) -> dict:
    """Roots, depths, sizes and pre-order of whole trees in arrays."""
    size, node = batch.column("size").to_numpy().copy(), batch.column("node_id").to_numpy()
    depth, root = np.zeros(len(size), np.int32), np.arange(len(size))
    ended, length = jump < 0, 1

    def sizes(rows, to):
        nonlocal length
        gain = np.bincount(to, size[rows], len(size)).astype(np.int64)
        now = ended[to]  # such a jump has reached its root and knows its depth
        depth[rows[now]], root[rows[now]] = length + depth[to[now]], root[to[now]]
        ended[rows] = now
        size[:] += gain
        length *= 2

    _doubling(jump, sizes)
    tin = _placed(size, batch.column("rank").to_numpy(), jump, tree)

    def tins(rows, to):
        tin[rows] = tin[to] + tin[rows]

    _doubling(jump, tins)
    return {"root_id": node[root], "depth": depth, "size": size, "tin": tin}


def _doubled(big: DataFrame) -> DataFrame:
    """What ``_solve`` gives, by rounds of joins."""
    up = packed(big.select(*KEY, "jump", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), "size"), "jumps")
    total, rounds = up.count(), 0
    while not (open_ := up.where("jump is not null")).isEmpty():
        rounds += 1
        if 2 ** (rounds - 1) > total:
            raise ValueError(CYCLE)
        # where a jump has none of its own, it has reached its root and knows its depth
        above = up.select("tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("_next"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"))
        joined = open_.join(above, ["tree_id", "jump"], "left")
        onward = F.when(F.col("_root").isNull(), _missing(F.col("jump")).cast("bigint")).otherwise(F.col("_next"))
        length = F.lit(2 ** (rounds - 1)) + F.col("_depth")
        moved = joined.select(*KEY, onward.alias("jump"), F.col("_root").alias("root_id"), F.when(onward.isNull(), length).otherwise(0).cast("int").alias("depth"), "size")
        more = open_.groupBy("tree_id", F.col("jump").alias("node_id")).agg(F.sum("size").alias("_more"))
        whole = moved.union(up.where("jump is null").select(moved.columns)).join(more, KEY, "left")
        last, up = up, packed(whole.select(*KEY, "jump", "root_id", "depth", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")), "jumps")
        discard(last)
    sized = big.select(*KEY, "jump", "rank").join(up.drop("jump"), KEY)
    kin = F.coalesce("jump", F.lit(-(1 << 63))).alias("_kin")  # several roots of a tree follow each other
    placed = sum_before(sized.select(*KEY, "jump", kin, "rank", "size"), ["tree_id", "_kin"], "rank", F.col("size") - 1, "_before")
    tins = along(placed.select(*KEY, "jump", F.lit(False).alias("is_leaf"), (F.col("rank") + F.col("_before")).cast("bigint").alias("tin")), {"tin": "sum"})
    return up.drop("jump").join(tins, KEY)


def _cut(big: DataFrame) -> DataFrame | None:
    """What ``_solve`` gives for trees too large for a task, if they fall apart near their roots: the nodes of the first level that has many are the heads of
    parts; rounds of doubled jumps tell every node its head, each part is solved in a task, then the few nodes above the heads, and the parts are put
    in their places. None if a part would be too large, or there is no such level."""
    total = big.count()
    level, tops = packed(big.where("jump is null"), "level"), []
    for depth in range(1, 17):
        tops.append(level)
        above = level.select("tree_id", F.col("node_id").alias("jump"))
        level = packed(big.join(above, ["tree_id", "jump"]).select(big.columns), "level")
        many = level.count()
        if not many or many * LOCAL >= PARTS * total:
            break
    if not many or many * LOCAL < PARTS * total:
        discard(*tops, level)
        return None
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    # a node's ``at`` is a node above it, in the end (``closed``) its head
    known = level.select(*KEY, F.lit(True).alias("_head")).union(top.select(*KEY, F.lit(False)))
    at = packed(big.select(*KEY, "jump").join(known, KEY, "left").where("_head or _head is null").select(*KEY, F.when(F.col("_head"), F.col("node_id")).otherwise(F.col("jump")).alias("at"), F.coalesce("_head", F.lit(False)).alias("closed")), "at")
    rounds = 0
    while not (open_ := at.where("not closed")).isEmpty():
        rounds += 1
        if 2 ** (rounds - 1) > total:
            raise ValueError(CYCLE)
        above = at.select("tree_id", F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("closed").alias("_closed"))
        moved = open_.select(*KEY, "at").join(above, ["tree_id", "at"]).select(*KEY, F.col("_at").alias("at"), F.col("_closed").alias("closed"))
        last, at = at, packed(moved.union(at.where("closed")), "at")
        discard(last)
    largest = at.groupBy("tree_id", "at").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
    if largest > LOCAL:
        discard(*tops, level, at)
        return None
    kind = dict(big.dtypes)["tree_id"]
    head = F.col("node_id") == F.col("at")
    rows = big.join(at.drop("closed"), KEY).select("tree_id", F.col("at").alias("part"), "node_id", F.when(~head, F.col("jump")).alias("jump"), F.when(head, 0).otherwise(F.col("rank")).cast("bigint").alias("rank"), "size")
    parts = packed(_by_tree(rows, f"tree_id {kind}, part bigint, node_id bigint, depth int, size bigint, tin bigint", _solve, ("tree_id", "part")), "parts")
    discard(at)
    heads = packed(level.drop("size").join(parts.where("node_id = part").select(*KEY, "size"), KEY), "heads")
    below = heads.groupBy("tree_id", F.col("jump").alias("node_id")).agg(F.sum("size").alias("_more"))
    first = top.join(below, KEY, "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0)))
    first = packed(_by_tree(first.select(*KEY, "jump", "rank", "size"), SOLVED.format(kind), _solve), "top")
    over = first.select("tree_id", F.col("node_id").alias("jump"), F.col("root_id").alias("_root"), F.col("tin").alias("_over"))
    placed = sum_before(heads, ["tree_id", "jump"], "rank", F.col("size") - 1, "_before").join(over, ["tree_id", "jump"])
    placed = placed.select("tree_id", F.col("node_id").alias("part"), "_root", (F.col("_over") + F.col("rank") + F.col("_before")).alias("_tin"))
    found = parts.join(placed, ["tree_id", "part"]).select(*KEY, F.col("_root").alias("root_id"), (F.col("depth") + depth).cast("int").alias("depth"), "size", (F.col("tin") + F.col("_tin")).alias("tin"))
    out = packed(found.union(first.select(found.columns)), "cut")
    discard(*tops, level, parts, heads, first)
    return out


SOLVED = "tree_id {}, node_id bigint, root_id bigint, depth int, size bigint, tin bigint"
#: Parts of the size ``LOCAL`` that a level of heads must give at least.
PARTS = 16
#: Rows that are sent to all tasks.
MOST_SENT = 10_000
#: Children of a parent whose places are held in the bits of a number.
FEW = 62


def build(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``root_id, depth`` (0 at the root), ``n_children, is_leaf, size, tin, tout`` (pre-order, from 1). Raises an error on ids that
    repeat in a tree, on cycles and on missing parents.

    Two passes go over all nodes: narrow rows by id, which leave inner nodes, and whole rows by parent, to whose facts leaves add theirs. Children
    of a parent of many, or without numbers from 1 on, are ranked apart.
    """
    kin = F.coalesce("parent_id", F.lit(-(1 << 63))).alias("_kin")  # several roots of a tree follow each other
    none = F.lit(None)
    bit = F.expr(f"CASE WHEN child_ord BETWEEN 1 AND {FEW} THEN shiftleft(1L, child_ord - 1) ELSE 0L END")
    own = nodes.select(*KEY, "parent_id", "child_ord", F.lit(1).alias("_n"), none.cast("int").alias("_kids"), none.cast("bigint").alias("_bits"))
    under = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(none.cast("bigint"), none.cast("int"), none.cast("int"), F.count(F.lit(1)).cast("int"), F.bit_or(bit))
    shape = own.union(under).groupBy(*KEY).agg(F.max("parent_id").alias("parent_id"), F.max("child_ord").alias("child_ord"), F.sum("_n").alias("_n"), F.max("_kids").alias("n_children"), F.max("_bits").alias("_bits"))
    twice = F.raise_error(F.concat(F.lit("two nodes of a tree have the id "), F.col("node_id").cast("string"))).cast("bigint")
    parent = F.when(F.col("_n") > 1, twice).when(F.col("_n").isNull(), _missing(F.col("node_id")).cast("bigint")).otherwise(F.col("parent_id"))
    plain = F.expr(f"n_children <= {FEW} AND _bits = shiftleft(1L, n_children) - 1")
    shape = shape.where("n_children is not null or parent_id is null or _n > 1")
    shape = packed(shape.select(*KEY, parent.alias("jump"), "child_ord", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce(plain, F.lit(False)).alias("plain")), "shape")

    crowded = shape.where("not plain and n_children > 0").select("tree_id", F.col("node_id").alias("parent_id"))
    slim = nodes.select(*KEY, "parent_id", kin, "child_ord")
    crowd = slim.join(sent(crowded.withColumn("_crowd", F.lit(True))), ["tree_id", "parent_id"], "left").where("_crowd or parent_id is null").drop("_crowd")
    kin_rows = packed(crowd, "crowd")
    crowd = sum_before(kin_rows, ["tree_id", "_kin"], "child_ord", F.lit(1), "_earlier").select(*KEY, (F.col("_earlier") + 1).alias("_rank"))
    inside = shape.where("jump is not null").groupBy("tree_id", F.col("jump").alias("node_id")).agg(F.count(F.lit(1)).alias("_inner"))
    rank = F.coalesce("_rank", F.col("child_ord").cast("bigint"))
    inner = shape.join(inside, KEY, "left").join(crowd, KEY, "left")
    inner = packed(inner.select(*KEY, "jump", rank.alias("rank"), (1 + F.col("n_children") - F.coalesce("_inner", F.lit(0))).cast("bigint").alias("size"), "n_children", "plain", F.col("_rank").isNotNull().alias("crowded")), "inner")
    discard(shape, kin_rows)

    ranked = inner.select(*KEY, "jump", "rank", "size")
    small, big = _split(ranked)
    found = _by_tree(small, SOLVED.format(dict(nodes.dtypes)["tree_id"]), _solve)
    if big is not None:
        large = _cut(big)
        found = found.union(_doubled(big) if large is None else large)
    try:
        facts = packed(inner.drop("size").join(found, KEY), "facts")
    except PythonException as e:
        if CYCLE in str(e):  # as where trees are too large for a task
            raise ValueError(CYCLE) from e
        raise
    if big is not None and large is not None:
        discard(large)

    beside = facts.where("not crowded").groupBy("tree_id", F.col("jump").alias("parent_id")).agg(F.collect_list(F.struct(F.col("rank").alias("o"), F.col("node_id").alias("id"), F.col("size").alias("s"), F.col("n_children").alias("n"))).alias("_beside"))
    over = facts.where("plain").select("tree_id", F.col("node_id").alias("parent_id"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("tin").alias("_tin")).join(beside, ["tree_id", "parent_id"], "left")
    me = F.get(F.filter("_beside", lambda x: x.id == F.col("node_id")), F.lit(0))
    earlier = F.coalesce(F.aggregate("_beside", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.o < F.col("child_ord"), x.s - 1).otherwise(0)), F.lit(0))
    met = nodes.join(over, ["tree_id", "parent_id"], "left").withColumn("_me", me)
    places = {"root_id": F.col("_root"), "depth": F.col("_depth") + 1, "n_children": F.coalesce("_me.n", F.lit(0)), "size": F.coalesce("_me.s", F.lit(1)).cast("bigint"), "tin": F.col("_tin") + F.col("child_ord") + earlier}
    first = packed(met.select(*nodes.columns, *[c.alias(n) for n, c in places.items()]), "index")

    apart = packed(first.where("tin is null").select(*nodes.columns), "index-apart")
    rest = apart.withColumn("_kin", kin)
    own = facts.select(*KEY, *[F.col(c).alias(f"_own_{c}") for c in ("root_id", "depth", "n_children", "size", "tin")])
    up = facts.select("tree_id", F.col("node_id").alias("parent_id"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("tin").alias("_tin"))
    rest = sum_before(rest.join(own, KEY, "left"), ["tree_id", "_kin"], "child_ord", F.coalesce("_own_size", F.lit(1)), "_before").join(up, ["tree_id", "parent_id"], "left")
    places = {"root_id": F.col("_root"), "depth": F.col("_depth") + 1, "n_children": F.lit(0), "size": F.lit(1).cast("bigint"), "tin": F.col("_tin") + 1 + F.col("_before")}
    rest = packed(rest.select(*nodes.columns, *[F.coalesce(f"_own_{n}", c).alias(n) for n, c in places.items()]), "index-rest")
    discard(inner, facts, apart)
    both = first.where("tin is not null").union(rest)
    return both.select(*nodes.columns, "root_id", F.col("depth").cast("int").alias("depth"), F.col("n_children").cast("int").alias("n_children"), (F.col("n_children") == 0).alias("is_leaf"), "size", F.col("tin").cast("bigint").alias("tin"), (F.col("tin") + F.col("size") - 1).cast("bigint").alias("tout"))
