"""Attributes per symbol: adding, dropping, renaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _symbols(tree, symbols) -> list[str]:
    return list(tree.catalog) if symbols is None else [symbols] if isinstance(symbols, str) else list(symbols)


def add_column(tree, symbols, name: str, kind: T.DataType | str, default=None):
    """Give symbols an attribute. An error if one has it already; an unknown symbol is entered in the catalog."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    names = _symbols(tree, symbols)
    if had := [s for s in names if tree.has(s, name)]:
        raise ValueError(f"{', '.join(had)} has {name} already")
    old = F.col(name) if name in tree.nodes.columns else F.lit(None).cast(kind)
    nodes = tree.nodes.withColumn(name, F.when(F.col("symbol").isin(names), F.lit(default).cast(kind)).otherwise(old))
    catalog = {**tree.catalog}
    for s in names:
        catalog[s] = {**catalog.get(s, {}), name: kind}
    return tree.with_nodes(nodes, True, catalog=catalog)


def drop_column(tree, symbols, name: str):
    """Take an attribute from symbols; no error where it is absent."""
    names = _symbols(tree, symbols)
    catalog = {s: {a: k for a, k in c.items() if a != name or s not in names} for s, c in tree.catalog.items()}
    if name not in tree.nodes.columns:
        return tree
    if not any(name in c for c in catalog.values()):
        return tree.with_nodes(tree.nodes.drop(name), True, catalog=catalog)
    return tree.with_nodes(tree.nodes.withColumn(name, F.when(~F.col("symbol").isin(names), F.col(name))), True, catalog=catalog)


def rename_column(tree, symbols, old: str, new: str):
    """Rename an attribute of symbols; nothing happens where ``old`` is absent, an error where ``new`` exists."""
    names = [s for s in _symbols(tree, symbols) if tree.has(s, old)]
    if not names or old == new:
        return tree
    if had := [s for s in names if tree.has(s, new)]:
        raise ValueError(f"{', '.join(had)} has {new} already")
    catalog = {s: {new if a == old and s in names else a: k for a, k in c.items()} for s, c in tree.catalog.items()}
    moved = F.col("symbol").isin(names)
    nodes = tree.nodes
    if not any(old in c for c in catalog.values()) and new not in nodes.columns:
        return tree.with_nodes(nodes.withColumnRenamed(old, new), True, catalog=catalog)
    there = F.col(new) if new in nodes.columns else F.lit(None)
    nodes = nodes.withColumn(new, F.when(moved, F.col(old)).otherwise(there))
    nodes = nodes.withColumn(old, F.when(~moved, F.col(old))) if any(old in c for c in catalog.values()) else nodes.drop(old)
    return tree.with_nodes(nodes, True, catalog=catalog)


def unify(*trees):
    """One frame of several: attributes by name, numbers widened to double, other conflicts to string."""
    kinds: dict[str, T.DataType] = {}
    for t in trees:
        for f in t.nodes.schema.fields:
            if f.name in t.attributes:
                kinds[f.name] = widened(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out, catalog = None, {}
    for t in trees:
        nodes = t.nodes.withColumns({a: F.col(a).cast(kinds[a]) for a in t.attributes})
        out = nodes if out is None else out.unionByName(nodes, allowMissingColumns=True)
        for s, c in t.catalog.items():
            catalog[s] = {**catalog.get(s, {}), **{a: kinds.get(a, k) for a, k in c.items()}}
    return trees[0].with_nodes(out, catalog=catalog)


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()
