"""Attributes: reading, setting, transforming, selecting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Filter, navigating
from .index import KEY


def _replaced(tree, name: str, value: Column, passes: Column, symbols: list[str] | None = None):
    """``tree`` with ``name`` set to ``value`` where ``passes``; elsewhere it keeps what it was."""
    old = F.col(name) if name in tree.nodes.columns else F.lit(None)
    nodes = tree.nodes.withColumn(name, F.when(passes, value).otherwise(old))
    return tree.with_nodes(nodes, True, catalog=tree.catalog_with(name, nodes.schema[name].dataType, symbols))


def attribute(tree, name: str, default=None) -> DataFrame:
    """The attribute of every node; the default stands where the node's symbol does not have it, a null value stays null."""
    having = [s for s in tree.catalog if tree.has(s, name)]
    column = F.col(name) if name in tree.nodes.columns else F.lit(None)
    value = column if default is None else F.when(F.col("symbol").isin(having), column).otherwise(F.lit(default))
    return tree.nodes.select(*KEY, value.alias(name))


def set_attribute(tree, name: str, value, where):
    """Set one attribute (also link, symbol, index or scale) of the nodes that ``where`` picks."""
    return _replaced(tree, name, value if isinstance(value, Column) else F.lit(value), Filter(where=where).column())


def append(tree, values: dict, where):
    """Merge several attributes into the nodes that ``where`` picks."""
    for name, value in values.items():
        tree = set_attribute(tree, name, value, where)
    return tree


def attributes(tree, format: str = "struct") -> DataFrame:
    """All attributes of every node, as a struct or a map of strings."""
    if format == "struct":
        packed = F.struct(*tree.attributes)
    elif format == "map":
        packed = F.create_map(*[x for a in tree.attributes for x in (F.lit(a), F.col(a).cast("string"))])
    else:
        raise ValueError("format must be struct or map")
    return tree.nodes.select(*KEY, packed.alias("attributes"))


def pop(tree, name: str, symbol: str):
    """The values of an attribute of a symbol, and the tree without the attribute in that symbol."""
    from .schema import drop_column

    return tree.nodes.where(F.col("symbol") == symbol).select(*KEY, name), drop_column(tree, symbol, name)


def call_name(columns: list[str], fn: Callable) -> str:
    called = getattr(fn, "__name__", "function")
    return "_".join([*columns, "function" if called == "<lambda>" else called])


def _strings(x) -> bool:
    return isinstance(x, str) or (isinstance(x, (list, tuple)) and bool(x) and all(isinstance(i, str) for i in x))


@navigating
def transform(tree, *forms, scale=None, symbol=None, link=None, where=None, ignore_nothing: bool = False):
    """Apply forms in order: ``("a", "b")`` renames; ``("a", f, "b")`` and ``(["a", "b"], f, "c")`` compute from
    attributes; ``("a", f)`` names the result itself; ``(f, "b")`` computes from the whole tree; ``f`` takes and gives a tree;
    a bare name does nothing.

    Functions of attributes take and give Columns. A function of the tree gives a Column, or rows
    (tree_id, node_id or start_id, value) that are joined back.
    """
    kept = Filter(scale, symbol, link, where)
    for form in forms:
        if isinstance(form, str):
            continue
        if callable(form):
            tree = form(tree)
            continue
        form = tuple(form)
        if len(form) == 2 and _strings(form[0]) and isinstance(form[1], str):
            tree = _rename_filtered(tree, form[0], form[1], kept)
        elif len(form) == 2 and callable(form[0]):
            value, passes = form[0](tree), kept.column()
            if isinstance(value, DataFrame):
                value = value.withColumnRenamed("start_id", "node_id") if "start_id" in value.columns else value
                name = next(c for c in value.columns if c not in KEY)
                nodes = tree.nodes.join(value.select(*KEY, F.col(name).alias("_value")), KEY, "left")
                tree = tree.with_nodes(nodes, True)
                tree = _replaced(tree, form[1], F.col("_value"), passes)
                tree = tree.with_nodes(tree.nodes.drop("_value"), True)
            else:
                tree = _replaced(tree, form[1], value, passes)
        else:
            columns = [form[0]] if isinstance(form[0], str) else list(form[0])
            name = form[2] if len(form) == 3 else call_name(columns, form[1])
            passes = kept.column()
            if ignore_nothing:
                for c in columns:
                    passes = passes & F.col(c).isNotNull()
            tree = _replaced(tree, name, form[1](*map(F.col, columns)), passes)
    return tree


def _rename_filtered(tree, old: str, new: str, kept: Filter):
    """A rename acts on whole symbols: on those that have a node that passes."""
    from .schema import rename_column

    symbols = None if kept.empty else [r.symbol for r in tree.nodes.where(kept.column()).select("symbol").distinct().collect()]
    return rename_column(tree, symbols, old, new)


def select(tree, *forms, **filters):
    """Transform, then drop every attribute that no form names."""
    done = transform(tree, *forms, **filters)
    names = []
    for form in forms:
        if isinstance(form, str):
            names.append(form)
        elif not callable(form):
            form = tuple(form)
            if isinstance(form[-1], str):
                names.append(form[-1])
            else:
                names.append(call_name([form[0]] if isinstance(form[0], str) else list(form[0]), form[1]))
        else:
            names += [a for a in form(tree).attributes if a not in tree.attributes]
    keep = [a for a in done.attributes if a in names]
    nodes = done.nodes.drop(*[a for a in done.attributes if a not in keep])
    return done.with_nodes(nodes, True, catalog={s: {a: k for a, k in c.items() if a in keep} for s, c in done.catalog.items()})


@navigating
def mutate(tree, assignments: dict[str, Column | str], scale=None, symbol=None, link=None, where=None, all: bool = True):
    """Assign expressions in order; later ones see earlier ones. ``all=False`` ends at the first node, in pre-order,
    that the filter does not pass."""
    filt = Filter(scale, symbol, link, where)
    if all or filt.empty:
        for name, value in assignments.items():
            tree = _replaced(tree, name, F.expr(value) if isinstance(value, str) else value, filt.column())
        return tree
    marks = tree.indexed.select(*KEY, "tin", (~filt.column()).alias("_fails"))
    stop = marks.where("_fails").groupBy("tree_id").agg(F.min("tin").alias("_stop"))
    seen = marks.join(stop, "tree_id", "left").select(*KEY, (F.col("_stop").isNull() | (F.col("tin") < F.col("_stop"))).alias("_seen"))
    out = tree.with_nodes(tree.nodes.join(seen, KEY), True)
    for name, value in assignments.items():
        out = _replaced(out, name, F.expr(value) if isinstance(value, str) else value, F.col("_seen"))
    return out.with_nodes(out.nodes.drop("_seen"), True)


def per_tree(tree, fn, schema: str | T.StructType) -> DataFrame:
    """For what no expression can say: ``fn`` takes the rows of one tree as a pandas DataFrame, in pre-order, and
    gives one. A tree must fit in a task's memory."""
    return tree.indexed.groupBy("tree_id").applyInPandas(lambda rows: fn(rows.sort_values("tin")), schema)


def equal_nodes(a, b) -> DataFrame:
    """Of every id in either tree whether both have the same node: parent, encoding, attributes and children."""
    columns = [c for c in a.nodes.columns if c not in KEY]
    if set(columns) != {c for c in b.nodes.columns if c not in KEY}:
        return a.nodes.select(*KEY, F.lit(False).alias("equal"))

    def packed(t, name):
        kids = t.nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("child_ord", F.col("node_id").alias("id")))).alias("_kids"))
        return t.nodes.join(kids, KEY, "left").select(*KEY, F.struct(*columns, "_kids").alias(name))

    both = packed(a, "_a").join(packed(b, "_b"), KEY, "full")
    return both.select(*KEY, F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))


def trees_equal(a, b) -> bool:
    return equal_nodes(a, b).where("not equal").isEmpty()
