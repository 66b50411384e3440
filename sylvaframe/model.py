"""The data model: many multi-scale trees in one node table.

``nodes`` has one row per node: ``tree_id, node_id, parent_id, child_ord, link, symbol, index, scale`` and
nullable attribute columns. ``catalog`` says which attributes each symbol has, ``header`` keeps
what belongs to the file and not to a node. A TreeFrame is never changed; operators return new ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import index as _index

LINKS = ("/", "<", "+")
NO_INDEX = -9999
TOPOLOGY = ("tree_id", "node_id", "parent_id", "child_ord", "link", "symbol", "index", "scale")
TOPOLOGY_SCHEMA = "tree_id string, node_id bigint, parent_id bigint, child_ord int, link string, symbol string, index int, scale int"


@dataclass(frozen=True)
class TreeFrame:
    nodes: DataFrame
    catalog: dict[str, dict[str, T.DataType]] = field(default_factory=dict)
    header: dict = field(default_factory=dict)
    strategy: str = "auto"  # of pairs of nodes: by pre-order (interval, auto) or by paths (closure)
    topology: TreeFrame | None = None  # a frame with the same nodes and parents, whose index holds here, too

    def __post_init__(self):
        if self.strategy not in ("auto", "closure", "interval"):
            raise ValueError("strategy must be auto, closure or interval")

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in TOPOLOGY]

    @cached_property
    def indexed(self) -> DataFrame:
        """``nodes`` with ``root_id, depth, n_children, is_leaf, size, tin, tout``; built once for a topology."""
        if self.topology is not None:
            return self.nodes.join(self.topology.indexed.select(*_index.KEY, *_index.COLUMNS), _index.KEY)
        return _index.build(self.nodes)

    @cached_property
    def largest(self) -> int:
        """Nodes of the largest tree."""
        return self.topology.largest if self.topology is not None else self.indexed.agg(F.max("size")).head()[0] or 0

    @cached_property
    def paths(self) -> DataFrame:
        """``tree_id, node_id, path``, for the strategy ``closure``."""
        return self.topology.paths if self.topology is not None else _index.paths(self.nodes)

    def pairs(self, above: DataFrame, below: DataFrame, own: bool = True, upper: list[str] = (), lower: list[str] = (), most: int | None = None) -> DataFrame:
        """``tree_id, anc_id, node_id, dist`` of rows of the index and the rows in their subtrees, with columns of both."""
        if self.strategy == "closure":
            rows = _index.closure(below, self.paths, *lower).join(above.select("tree_id", F.col("node_id").alias("anc_id"), *upper), ["tree_id", "anc_id"])
            rows = rows.where(F.col("dist") >= (0 if own else 1))
            return (rows if most is None else rows.where(F.col("dist") <= most)).select("tree_id", "anc_id", "node_id", "dist", *upper, *lower)
        return _index.pairs(above, below, self.largest, own, list(upper), list(lower), most)

    def inside(self, node_id: int, tree_id: str | None = None) -> DataFrame:
        """The rows of the index in the subtree of a node (without ``tree_id``: in every tree that has the id)."""
        here = F.col("node_id") == node_id
        top = self.indexed.where(here if tree_id is None else here & (F.col("tree_id") == tree_id)).select("tree_id", F.col("tin").alias("_low"), F.col("tout").alias("_high"))
        return self.indexed.join(top, "tree_id").where("tin between _low and _high").drop("_low", "_high")

    def with_nodes(self, nodes: DataFrame, same_topology: bool = False, **changes) -> TreeFrame:
        """A frame of other nodes. With ``same_topology`` only attributes differ, and the index is not built anew."""
        return replace(self, nodes=nodes, topology=(self.topology or self) if same_topology else None, **changes)

    def has(self, symbol: str, attribute: str) -> bool:
        return attribute in self.catalog.get(symbol, {})

    def catalog_with(self, attribute: str, kind: T.DataType, symbols: list[str] | None = None) -> dict:
        """The catalog with an attribute added to some symbols (all by default)."""
        return {s: {**a, attribute: kind} if symbols is None or s in symbols else a for s, a in self.catalog.items()}


def valid(nodes: DataFrame) -> DataFrame:
    """``nodes``, raising an error where a link or a scale is none."""
    ok = F.col("link").isin(*LINKS) & (F.col("scale") >= 0)
    bad = F.raise_error(F.concat(F.lit("link must be one of / < + and scale at least 0, node "), F.col("node_id").cast("string")))
    return nodes.withColumn("scale", F.when(ok, F.col("scale")).otherwise(bad.cast("int")))


def from_nodes(nodes: DataFrame, catalog: dict | None = None, header: dict | None = None, check: bool = True) -> TreeFrame:
    """A TreeFrame of a node table. Missing ``tree_id`` is one tree, missing ``child_ord`` the order of ids.

    Without a catalog every attribute belongs to every symbol of the table that has a value of it.
    """
    if "tree_id" not in nodes.columns:
        nodes = nodes.withColumn("tree_id", F.lit("tree"))
    if "child_ord" not in nodes.columns:
        from pyspark.sql import Window

        nodes = nodes.withColumn("child_ord", F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy("node_id")))
    if "index" not in nodes.columns:
        nodes = nodes.withColumn("index", F.lit(None))
    attributes = [c for c in nodes.columns if c not in TOPOLOGY]
    shape = dict(f.split(" ") for f in TOPOLOGY_SCHEMA.split(", "))
    nodes = nodes.select(*[F.coalesce(F.col("index"), F.lit(NO_INDEX)).cast("int").alias("index") if c == "index" else F.col(c).cast(shape[c]).alias(c) for c in TOPOLOGY], *attributes)
    if check:
        nodes = valid(nodes)
    if catalog is None:
        kinds = {f.name: f.dataType for f in nodes.schema.fields}
        rows = nodes.groupBy("symbol").agg(*[F.count(a).alias(a) for a in attributes], F.count(F.lit(1)).alias("_n")).collect()
        catalog = {r["symbol"]: {a: kinds[a] for a in attributes if r[a]} for r in rows}
    return TreeFrame(nodes, catalog, header or {})


def node(spark: SparkSession, link: str, symbol: str, index: int | None = None, scale: int = 0, attributes: dict | None = None, node_id: int = 1, tree_id: str = "tree") -> TreeFrame:
    """A tree of one root node."""
    if link not in LINKS or scale < 0:
        raise ValueError(f"link must be one of {LINKS} and scale at least 0")
    if not isinstance(attributes or {}, dict):
        raise TypeError("attributes must be a dict")
    row = {"tree_id": tree_id, "node_id": node_id, "parent_id": None, "child_ord": 1, "link": link, "symbol": symbol, "index": NO_INDEX if index is None else index, "scale": scale}
    base = spark.createDataFrame([row], TOPOLOGY_SCHEMA)
    return from_nodes(base.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in (attributes or {}).items()}))
