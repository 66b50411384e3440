"""Flat tables, graphs and text drawings of trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mtg_table(tree, variables: list[str] | None = None, start: int | None = None) -> DataFrame:
    """Every node with its encoding, parent and attributes (null where absent); ``tin`` is the pre-order."""
    rows = tree.indexed if start is None else tree.inside(start)
    names = tree.attributes if variables is None else variables
    return rows.select("tree_id", "node_id", "symbol", "scale", "index", "link", "parent_id", *[F.col(v) if v in tree.attributes else F.lit(None).cast("string").alias(v) for v in names], "tin")


def symbol_table(tree, symbol: str, variables: list[str] | None = None) -> DataFrame:
    """The nodes of one symbol, in all of every tree, with the attributes of that symbol."""
    names = list(tree.catalog.get(symbol, {})) if variables is None else variables
    return tree.nodes.where(F.col("symbol") == symbol).select("tree_id", "node_id", *[F.col(v) if v in tree.attributes else F.lit(None).cast("string").alias(v) for v in names])


def to_table(tree, symbol: str | None = None, variables: list[str] | None = None, sink: Callable | str | None = None):
    """One of the tables, given to a sink: a function, ``"pandas"``, or nothing."""
    table = mtg_table(tree, variables) if symbol is None else symbol_table(tree, symbol, variables)
    if sink is None:
        return table
    if sink == "pandas":
        return table.toPandas()
    if callable(sink):
        return sink(table)
    raise TypeError("a sink is a function or 'pandas'")


def to_graph(tree) -> tuple[DataFrame, DataFrame]:
    """Vertices (tree_id, id, encoding, attributes) and edges (tree_id, src, dst, link, weight) from parent to child."""
    vertices = tree.nodes.select("tree_id", F.col("node_id").alias("id"), "symbol", "index", "scale", *tree.attributes)
    edges = tree.nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), "link", F.lit(1.0).alias("weight"))
    return vertices, edges


def drawing(tree, variables: list[str] | None = None, limit: int = 40, tree_id: str | None = None) -> str:
    """The first ``limit`` nodes of a tree in pre-order, drawn with branches."""
    rows = tree.indexed if tree_id is None else tree.indexed.where(F.col("tree_id") == tree_id)
    top = rows.orderBy("tree_id", "tin").limit(limit + 1).select("node_id", "parent_id", "link", "symbol", "index", "depth", "child_ord", *(variables or [])).collect()
    counts = {r.node_id: r.n_children for r in rows.where(F.col("node_id").isin([r.node_id for r in top])).select("node_id", "n_children").collect()}
    out, bars = [], []
    for r in top[:limit]:
        bars = bars[: max(r.depth - 1, 0)]
        text = f"{r.link}{r.symbol}{'' if r['index'] == -9999 else r['index']}" if variables is None else " ".join(f"{v}: {r[v]}" for v in variables)
        if r.depth == 0:
            out.append(f"{r.node_id}: {text}")
            continue
        last = r.child_ord == counts.get(r.parent_id, r.child_ord)
        out.append("".join(bars) + ("└─ " if last else "├─ ") + f"{r.node_id}: {text}")
        bars.append("   " if last else "│  ")
    if len(top) > limit:
        out.append("⋮")
    return "\n".join(out)
