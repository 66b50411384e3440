"""Trees from tables: any table of ids and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TreeFrame, from_nodes


def from_edges(df: DataFrame, id: str, parent: str, symbol="symbol", scale="scale", link="link", index="index", tree: str | None = None, order: str | None = None, attributes: list[str] | None = None, catalog: dict | None = None, header: dict | None = None) -> TreeFrame:
    """A TreeFrame of a table with an id and a parent id per row. ``symbol, scale, link, index`` name columns or are Columns;
    children are ordered by ``order`` (by id if none)."""
    from pyspark.sql import Window

    def of(x):
        return F.col(x) if isinstance(x, str) else x

    known = set(df.columns)
    base = {
        "tree_id": F.col(tree).cast("string") if tree else F.lit("tree"),
        "node_id": F.col(id).cast("bigint"),
        "parent_id": F.col(parent).cast("bigint"),
        "link": of(link),
        "symbol": of(symbol),
        "index": of(index) if not isinstance(index, str) or index in known else F.lit(None).cast("int"),
        "scale": of(scale),
    }
    taken = {id, parent, tree, order, *[x for x in (symbol, scale, link, index) if isinstance(x, str)]}
    attributes = [c for c in df.columns if c not in taken] if attributes is None else attributes
    rows = df.select(*[c.alias(n) for n, c in base.items()], *([F.col(order).alias("_order")] if order else []), *attributes)
    by = ["_order", "node_id"] if order else ["node_id"]
    rows = rows.withColumn("child_ord", F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy(*by)))
    return from_nodes(rows.drop("_order"), catalog, header)
