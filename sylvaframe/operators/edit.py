"""Structural edits. All of them are bulk rewrites of the node table by joins and windows.

Which nodes an edit touches is decided on the tree as it was; new ids follow the post-order of the matched
nodes after the tree's largest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import new_child_link, segment_child_link
from ..storage import discard, packed
from .filters import Filter, navigating
from .index import KEY, path_sums, sent, subtree_sums, sum_before
from .schema import unify


def _column(x) -> Column:
    return x() if callable(x) else x if isinstance(x, Column) else F.lit(x)


def _is(node_id: int, tree_id: str | None, column: str = "node_id") -> Column:
    """The node of one tree, or of every tree that has the id."""
    here = F.col(column) == node_id
    return here if tree_id is None else here & (F.col("tree_id") == tree_id)


def _matched(tree, scale=None, symbol=None, link=None, where=None, all: bool = True, start=None) -> DataFrame:
    """The index rows that an edit matches; ``all=False`` leaves out those below another match."""
    rows = (tree.indexed if start is None else tree.inside(start)).withColumn("_m", Filter(scale, symbol, link, where).column())
    if not all:  # the first match on its path
        rows = rows.join(path_sums(rows, F.col("_m").cast("int"), "_matches"), KEY).where("_matches = 1").drop("_matches")
    return rows.where("_m").drop("_m")


def _ordered(nodes: DataFrame, *key: str) -> DataFrame:
    """Dense child numbers by a sort key."""
    return nodes.withColumn("child_ord", F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy(*key, "node_id")))


def _insert(tree, kind: str, template, attributes: dict | None, matched: DataFrame):
    biggest = tree.nodes.groupBy("tree_id").agg(F.max("node_id").alias("_max"))
    post = F.col("tin") - F.col("depth") + F.col("size")
    ranked = sum_before(matched.withColumn("_post", post), ["tree_id"], "_post", F.lit(1), "_rank").drop("_post")
    new = ranked.join(biggest, "tree_id").withColumn("_new", F.col("_max") + F.col("_rank") + 1)
    template = template() if callable(template) else template
    attributes = attributes or {}
    if kind == "sibling":
        bad = F.raise_error(F.lit("the root has no siblings")).cast("bigint")
        parent = F.when(F.col("parent_id").isNull(), bad).otherwise(F.col("parent_id"))
    else:
        parent = F.col("parent_id") if kind == "parent" else F.col("node_id")
    values = {k: _column(v) for k, v in attributes.items()}
    old = {f.name: f.dataType for f in tree.nodes.schema.fields if f.name in tree.attributes}
    encoding = {k: _column(template.get(k, -9999 if k == "index" else None)).cast("int" if k in ("index", "scale") else "string") for k in ("link", "symbol", "index", "scale")}
    added = new.select(
        "tree_id",
        F.col("_new").alias("node_id"),
        parent.alias("parent_id"),
        F.col("child_ord").alias("_by"),
        *[v.alias(k) for k, v in encoding.items()],
        *[(values[a].cast(k) if a in values else F.lit(None).cast(k)).alias(a) for a, k in old.items()],
        *[v.alias(a) for a, v in values.items() if a not in old],
    )
    rows = tree.nodes
    for f in added.schema.fields:
        if f.name not in rows.columns and f.name != "_by":
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    pairs = new.select("tree_id", F.col("node_id").alias("_v"), "_new")
    if kind == "parent":  # the match goes under its new parent
        rows = rows.join(pairs, (rows["tree_id"] == pairs["tree_id"]) & (rows["node_id"] == pairs["_v"]), "left").drop(pairs["tree_id"])
        rows = rows.withColumn("parent_id", F.coalesce("_new", "parent_id")).drop("_v", "_new")
    elif kind == "generation":  # the children of the match go under the new node
        rows = rows.join(pairs, (rows["tree_id"] == pairs["tree_id"]) & (rows["parent_id"] == pairs["_v"]), "left").drop(pairs["tree_id"])
        rows = rows.withColumn("parent_id", F.coalesce("_new", "parent_id")).drop("_v", "_new")
    both = rows.withColumns({"_last": F.lit(0), "_by": F.col("child_ord")}).unionByName(added.withColumns({"_last": F.lit(1), "child_ord": F.lit(0)}))
    nodes = _ordered(both, "_last", "_by").select(*[c for c in rows.columns])
    catalog = tree.catalog
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    symbol = template.get("symbol")
    if values or isinstance(symbol, str):
        names = [symbol] if isinstance(symbol, str) else list(catalog)
        catalog = {**catalog, **{s: {**catalog.get(s, {}), **{a: kinds[a] for a in values}} for s in names}}
    header = tree.header
    if isinstance(symbol, str) and header.get("symbols") and symbol not in header["symbols"]:
        header = {**header, "symbols": [*header["symbols"], symbol]}
    return tree.with_nodes(nodes, catalog=catalog, header=header)


def _bulk(kind: str) -> Callable:
    @navigating
    def insert(tree, template, attributes: dict | None = None, scale=None, symbol=None, link=None, where=None, all: bool = True, start=None):
        return _insert(tree, kind, template, attributes, _matched(tree, scale, symbol, link, where, all, start))

    insert.__doc__ = f"""Insert a {kind} for every node that matches.

    ``template`` has link, symbol, index and scale; its values, and those of ``attributes``, may be Columns over
    the matched node. ``all=False`` does not look below a match.
    """
    return insert


def _single(kind: str) -> Callable:
    def insert(tree, node_id: int, template, attributes: dict | None = None, tree_id: str | None = None):
        return _insert(tree, kind, template, attributes, _matched(tree, where=_is(node_id, tree_id)))

    insert.__doc__ = f"Insert a {kind} for one node (without ``tree_id``: of every tree that has the id)."
    return insert


#: A new node between a match and its parent, last among the parent's children; above a root it becomes the root.
insert_parents, insert_parent = _bulk("parent"), _single("parent")
#: A new last child of a match.
insert_children, insert_child = _bulk("child"), _single("child")
#: A new last child of a match's parent; an error for roots.
insert_siblings, insert_sibling = _bulk("sibling"), _single("sibling")
#: A new only child of a match that takes over all its children.
insert_generations, insert_generation = _bulk("generation"), _single("generation")
add_child = insert_child


#: Different links up to which a run of deleted nodes is a table of what it makes of each; beyond, the runs themselves are carried.
MOST_LINKS = 16


def _link_table(tree, dead: DataFrame, child_link) -> list | None:
    """The links of the nodes and all that ``child_link`` makes of them, by and by; None if these are too many."""
    known = [r.link for r in tree.indexed.select("link").distinct().limit(MOST_LINKS + 1).collect()]
    gone = [r.link for r in dead.select("link").distinct().limit(MOST_LINKS + 1).collect()]
    while len(known) <= MOST_LINKS:
        pairs = tree.spark.createDataFrame([(c, d) for c in known for d in gone], "c string, d string")
        new = {r.x for r in pairs.select(child_link(F.col("c"), F.col("d")).cast("string").alias("x")).distinct().collect()} - set(known)
        if not new:
            return known
        known += sorted(new, key=str)
    return None


def _deleted_runs(dead: DataFrame, links: list | None, child_link) -> DataFrame:
    """Of every deleted node (tree_id, node_id, parent_id, link, tin, n_children) the nearest kept node above (``at``, null if there is none), and what the deleted nodes up to there
    do to the link of a child: for each of ``links`` the number of what becomes of it, or without ``links`` their own links from below. Jumps over deleted
    nodes are doubled, so a run of n takes log2 n rounds over the deleted nodes alone."""
    above = dead.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("open"))
    if links is None:
        does = F.array("link")
    else:
        does = F.array(*[_number(child_link(F.lit(v).cast("string"), F.col("link")), links) for v in links])
    at = packed(dead.join(above, ["tree_id", "parent_id"], "left").select(*KEY, F.col("parent_id").alias("at"), F.coalesce("open", F.lit(False)).alias("open"), does.alias("does"), "tin", "n_children"), "deleted")
    while not (open_ := at.where("open")).isEmpty():
        over = at.select("tree_id", F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("open").alias("_open"), F.col("does").alias("_does"))
        both = F.concat("does", "_does") if links is None else F.transform("does", lambda x: F.get("_does", x))
        moved = open_.join(over, ["tree_id", "at"]).select(*KEY, F.col("_at").alias("at"), F.col("_open").alias("open"), both.alias("does"), "tin", "n_children")
        last, at = at, packed(moved.union(at.where("not open")), "deleted")
        discard(last)
    return at.drop("open")


def _number(link: Column, links: list) -> Column:
    out = F.lit(None).cast("int")
    for i, v in enumerate(links):
        out = F.when(link.eqNullSafe(F.lit(v).cast("string")), i).otherwise(out)
    return out


def _delete(tree, gone: Column | DataFrame, child_link) -> object:
    """Delete the nodes of ``gone`` (a condition or rows); their children go to the nearest kept node above, behind its own children."""
    if isinstance(gone, Column):
        rows = tree.indexed.withColumn("_d", F.coalesce(gone, F.lit(False)))
    else:
        rows = tree.indexed.join(gone.select(*KEY, F.lit(True).alias("_d")), KEY, "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    dead = packed(rows.where("_d").select(*KEY, "parent_id", "link", "tin", "n_children"), "deleted")
    links = _link_table(tree, dead, child_link)
    runs = _deleted_runs(dead, links, child_link)
    discard(dead)
    up = runs.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_moves"), F.col("at").alias("_parent"), F.col("does").alias("_does"), F.col("tin").alias("_behind"))
    out = rows.where("not _d").join(sent(up), ["tree_id", "parent_id"], "left")
    if links is None:
        link = F.aggregate("_does", F.col("link"), lambda c, d: child_link(c, d))
    else:
        link = F.get(F.array(*[F.lit(v).cast("string") for v in links]), F.get("_does", _number(F.col("link"), links)))
    # a deleted root must have one child, which becomes the root, and so on
    bad = runs.where("at is null and n_children <> 1").select("tree_id").distinct().withColumn("_bad", F.lit(True))
    if not bad.isEmpty():
        stop = F.raise_error(F.lit("can't delete a root that has not exactly one child"))
        out = out.join(sent(bad), "tree_id", "left").withColumn("child_ord", F.when(F.col("_bad"), stop.cast("int")).otherwise(F.col("child_ord")))
    # what moves comes in the pre-order of its old parents: a deleted node's kept children, then what was below its deleted ones
    out = out.withColumns({"link": F.when(F.col("_moves"), link).otherwise(F.col("link")), "parent_id": F.when(F.col("_moves"), F.col("_parent")).otherwise(F.col("parent_id")), "_behind": F.coalesce("_behind", F.lit(0))})
    return tree.with_nodes(_ordered(out, "_behind", "child_ord").select(*tree.nodes.columns))


def delete_node(tree, node_id: int, child_link=new_child_link, tree_id: str | None = None):
    """Delete one node (without ``tree_id``: of every tree that has the id). A root goes only if it has one child, which becomes the root."""
    return _delete(tree, _is(node_id, tree_id), child_link)


@navigating
def delete_bare(tree, scale=None, symbol=None, link=None, where=None):
    """Delete leaves that match, then nodes that match and have become leaves by that, and so on: every node
    of whose subtree all nodes match. Roots are kept."""
    fails = F.when(Filter(scale, symbol, link, where).column() & F.col("parent_id").isNotNull(), 0).otherwise(1)
    rows = tree.indexed.join(subtree_sums(tree.indexed, fails, "_kept"), KEY)
    return tree.with_nodes(_ordered(rows.where("_kept > 0"), "child_ord").select(*tree.nodes.columns))


@navigating
def delete_nodes(tree, scale=None, symbol=None, link=None, where=None, all: bool = True, start=None, child_link=new_child_link):
    """Delete all nodes that match, judged on the tree as it was. ``child_link(child, deleted)`` gives the new link
    of a child, for each deleted node on its way up. ``all=False`` deletes only the start nodes (roots) that match."""
    filt = Filter(scale, symbol, link, where).column()
    if not all:
        filt = filt & (F.col("parent_id").isNull() if start is None else F.col("node_id") == start)
        start = None
    return _delete(tree, filt if start is None else _matched(tree, where=filt, start=start), child_link)


def is_segment(tree) -> DataFrame:
    """Nodes between two others without branching: not a root, leaf or child of a root, with one child not linked by "+"."""
    child = tree.nodes.where("child_ord = 1").select("tree_id", F.col("parent_id").alias("node_id"), F.col("link").alias("_cl"))
    up = tree.nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_pp"))
    rows = tree.indexed.select(*KEY, "parent_id", "n_children").join(child, KEY, "left").join(up, ["tree_id", "parent_id"], "left")
    return rows.select(*KEY, F.coalesce((F.col("n_children") == 1) & F.col("_pp").isNotNull() & (F.col("_cl") != "+"), F.lit(False)).alias("is_segment"))


def delete_segments(tree):
    """Delete all segments; the child of one takes its place and link. As deleting a segment changes neither the number of children
    of its parent nor what that sees of its child's link, the tree as it was decides."""
    return _delete(tree, is_segment(tree).where("is_segment"), segment_child_link)


def prune(tree, node_id: int, tree_id: str | None = None):
    """Remove a node and all below it (without ``tree_id``: in every tree that has the id); an error for a root."""
    stop = F.raise_error(F.lit("can't prune at the root")).cast("bigint")
    cut = tree.inside(node_id, tree_id)
    cut = cut.select(*KEY, F.when(_is(node_id, tree_id) & F.col("parent_id").isNull(), stop).otherwise(F.lit(1)).alias("_cut"))
    rows = tree.indexed.join(cut, KEY, "left").where("_cut is null").drop("_cut")
    return tree.with_nodes(_ordered(rows, "child_ord").select(*tree.nodes.columns))


def attach(tree, other, parent_id: int, tree_id: str | None = None):
    """Hang the trees of ``other`` under a node of the trees with the same ``tree_id``, or of the one that is named. Returns the new frame and the
    mapping (tree_id, old_id, node_id): attached nodes get new ids after the largest, in pre-order."""
    if tree_id is not None:
        other = other.with_nodes(other.nodes.where(F.col("tree_id") == tree_id))
    last = tree.nodes.groupBy("tree_id").agg(F.max("node_id").alias("_max"))
    kids = tree.nodes.where(F.col("parent_id") == parent_id).groupBy("tree_id").agg(F.max("child_ord").alias("_kids"))
    mapping = other.indexed.join(last, "tree_id").select("tree_id", F.col("node_id").alias("old_id"), (F.col("_max") + F.col("tin")).alias("node_id"))
    up = mapping.select("tree_id", F.col("old_id").alias("parent_id"), F.col("node_id").alias("_parent"))
    own = mapping.select("tree_id", F.col("old_id").alias("node_id"), F.col("node_id").alias("_id"))
    rows = other.nodes.join(own, KEY).join(up, ["tree_id", "parent_id"], "left").join(kids, "tree_id", "left")
    root = F.col("parent_id").isNull()
    rows = rows.withColumns({"node_id": F.col("_id"), "child_ord": F.when(root, F.coalesce("_kids", F.lit(0)) + 1).otherwise(F.col("child_ord")), "parent_id": F.coalesce("_parent", F.lit(parent_id))})
    return unify(tree, other.with_nodes(rows.select(*other.nodes.columns))), mapping


def move(tree, node_id: int, parent_id: int, tree_id: str | None = None):
    """Give a node, with all below it, a new parent in the same tree, as its last child (without ``tree_id``: in every tree that has the id)."""
    here = _is(node_id, tree_id)
    rows = tree.nodes.withColumns({"parent_id": F.when(here, F.lit(parent_id)).otherwise(F.col("parent_id")), "_last": here.cast("int")})
    return tree.with_nodes(_ordered(rows, "_last", "child_ord").select(*tree.nodes.columns))


reparent = move


def rechildren(tree, node_id: int, children: list[int], tree_id: str | None = None):
    """Make the listed nodes the children of a node, in that order. Nodes that were its children and are not listed
    become roots of their own."""
    here = F.lit(True) if tree_id is None else F.col("tree_id") == tree_id
    place = F.array_position(F.lit(children), F.col("node_id")).cast("int")
    listed = here & (place > 0)
    rows = tree.nodes.withColumns(
        {
            "parent_id": F.when(listed, F.lit(node_id)).when(_is(node_id, tree_id, "parent_id"), F.lit(None)).otherwise(F.col("parent_id")),
            "_by": F.when(listed, place).otherwise(F.col("child_ord")),
        }
    )
    return tree.with_nodes(_ordered(rows, "_by").select(*tree.nodes.columns))


def replace_child(tree, node_id: int, nth: int, child_id: int, tree_id: str | None = None):
    """Put a node, with all below it, in the place of a node's n-th child (from 1). As a node has one parent, it leaves its old
    one, and the child that stood there becomes a root of its own."""
    new = _is(child_id, tree_id)
    old = _is(node_id, tree_id, "parent_id") & (F.col("child_ord") == nth)
    rows = tree.nodes.withColumns(
        {
            "parent_id": F.when(new, F.lit(node_id)).when(old, F.lit(None)).otherwise(F.col("parent_id")),
            "_by": F.when(new, F.lit(nth)).otherwise(F.col("child_ord")),
            "_second": (~new).cast("int"),
        }
    )
    return tree.with_nodes(_ordered(rows, "_by", "_second").select(*tree.nodes.columns))
