"""Rules for the link of a child whose parent goes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_child_link(child: Column, deleted: Column) -> Column:
    """A following child takes over the link of a deleted node that decomposes or branches; any other keeps its own."""
    return F.when((child == "<") & deleted.isin("/", "+"), deleted).otherwise(child)


def segment_child_link(child: Column, deleted: Column) -> Column:
    """The only child of a deleted segment stands for it: it branches or decomposes where the segment did."""
    return F.when(deleted.isin("/", "+"), deleted).otherwise(child)


def link_after(child: str, deleted: str, verbose: bool = True) -> str:
    """``new_child_link`` for two plain links; warns of the pairs whose outcome is a guess."""
    if verbose and {child, deleted} == {"+", "/"}:
        warnings.warn(f"the link of a child {child!r} below a deleted {deleted!r} is ambiguous; it stays {child!r}", stacklevel=2)
    return deleted if child == "<" and deleted in ("/", "+") else child
