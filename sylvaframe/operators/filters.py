"""The filter that all operators share: scale, symbol, link and any predicate, joined by "and"."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(x) -> list | None:
    if x is None:
        return None
    return list(x) if isinstance(x, Iterable) and not isinstance(x, str) else [x]


@dataclass(frozen=True)
class Filter:
    """``where`` is a Column, a SQL string, or a function without arguments that returns a Column; operators also take a
    function of the tree (see ``navigating``)."""

    scale: int | Iterable[int] | None = None
    symbol: str | Iterable[str] | None = None
    link: str | Iterable[str] | None = None
    where: Column | str | Callable[[], Column] | None = None

    @property
    def empty(self) -> bool:
        return self.scale is None and self.symbol is None and self.link is None and self.where is None

    def column(self) -> Column:
        out = F.lit(True)
        for name in ("scale", "symbol", "link"):
            if (v := _values(getattr(self, name))) is not None:
                out = out & F.col(name).isin(v)
        if self.where is not None:
            out = out & (F.expr(self.where) if isinstance(self.where, str) else self.where if isinstance(self.where, Column) else self.where())
        return F.coalesce(out, F.lit(False))


def navigating(operator):
    """Lets ``where`` of an operator be a function of the tree that returns the rows (tree_id, node_id or start_id) that pass,
    so that a filter can look at parents, children or anything else that can be asked of the tree."""

    signature = inspect.signature(operator)

    @wraps(operator)
    def run(tree, *args, **kwargs):
        asked = signature.bind(tree, *args, **kwargs).arguments
        where = asked.get("where", kwargs.get("where"))
        if not callable(where) or not inspect.signature(where).parameters:
            return operator(tree, *args, **kwargs)
        rows = where(tree)
        rows = rows.withColumnRenamed("start_id", "node_id") if "node_id" not in rows.columns else rows
        marked = tree.nodes.join(rows.select("tree_id", "node_id").distinct().withColumn("_reached", F.lit(True)), ["tree_id", "node_id"], "left")
        bound = signature.bind(tree.with_nodes(marked, True), *args, **kwargs)
        bound.arguments["where"] = F.coalesce("_reached", F.lit(False))
        out = operator(*bound.args, **bound.kwargs)
        nodes = getattr(out, "nodes", None)
        return out if nodes is None else replace(out, nodes=nodes.drop("_reached"))

    return run


def check_filters(tree, scale=None, symbol=None, link=None) -> list[str]:
    """Warn of filter values that the header does not know; returns the warnings."""
    known = {"scale": tree.header.get("scales"), "symbol": tree.header.get("symbols"), "link": ["/", "<", "+"]}
    said = []
    for name, wanted in (("scale", scale), ("symbol", symbol), ("link", link)):
        if known[name] and (odd := [v for v in _values(wanted) or [] if v not in known[name]]):
            said.append(f"{name} has no value {', '.join(map(str, odd))}; known are {', '.join(map(str, known[name]))}")
            warnings.warn(said[-1], stacklevel=2)
    return said


def is_filtered(tree, **filters) -> Column:
    """True where a node passes."""
    return Filter(**filters).column()
