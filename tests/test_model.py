import random

import pytest
from pyspark.sql import functions as F

from conftest import FILES
from sylvaframe import model
from sylvaframe.operators import aggregate as A
from sylvaframe.operators import compute as C
from sylvaframe.operators import convert as X
from sylvaframe.operators import edit as E
from sylvaframe.operators import query as Q
from sylvaframe.operators import schema as S
from sylvaframe.operators.filters import check_filters
from sylvaframe.sources.hierarchy import from_edges
from sylvaframe.sources.mtg_text import mtg_lines, parse_mtg, read_mtg, write_mtg


def column(df, name, by="node_id"):
    return [r[name] for r in df.orderBy(by).collect()]


# --- reading and writing ------------------------------------------------------------------------------------
def test_orchard_values(orchard):
    nodes = orchard.nodes
    assert column(nodes, "parent_id") == [None, 1, 2, 3, 4, 5, 4, 7, 7, 2]
    assert column(nodes, "symbol") == ["Scene", "Tree", "Limb", "Shoot", "Bud", "Fruit", "Shoot", "Shoot", "Bud", "Limb"]
    assert column(nodes, "index") == [3, 4, 1, 1, 1, 1, 2, 7, 2, -9999]
    assert column(nodes, "link") == ["/", "/", "/", "/", "+", "<", "<", "+", "+", "/"]
    assert column(nodes, "Length") == [None, None, None, 4.5, None, None, 3.0, 1.5, None, None]
    assert column(nodes, "girth") == [None, None, None, 1.25, None, 6.0, 0.75, None, None, None]
    assert column(nodes, "buds") == [None, None, None, 3, None, None, 2, 0, None, None]
    assert column(nodes, "open")[4] is True and column(nodes, "open")[8] is False
    assert str(column(nodes, "picked")[5]) == "2021-09-03"
    assert column(nodes, "note") == [None] * 5 + ["sweet", None, None, "dry", None]
    assert {r.RELTYPE: r.RIGHT for r in orchard.header["description"].collect()} == {"+": ["Shoot", "Bud"], "<": ["Fruit"]}


@pytest.mark.parametrize("other", ["orchard_gaps", "orchard_chain"])
def test_same_orchard(spark, orchard, other):
    tree = read_mtg(spark, f"{FILES}/{other}.mtg")
    assert [r[1:] for r in tree.nodes.orderBy("node_id").collect()] == [r[1:] for r in orchard.nodes.orderBy("node_id").collect()]


def test_several_files_and_no_attributes(spark):
    trees = read_mtg(spark, [f"{FILES}/hedge.mtg", f"{FILES}/orchard.mtg"])
    hedge = trees.nodes.where("tree_id = 'hedge.mtg'")
    assert column(hedge, "parent_id") == [None, 1, 2, 3, 3, 1]
    assert column(hedge, "scale") == [1, 2, 2, 3, 3, 2]
    assert column(hedge, "index") == [2, 1, 2, 1, -9999, 9]
    assert trees.nodes.count() == 16


def test_ranges(spark):
    tree = read_mtg(spark, f"{FILES}/ranges.mtg")
    assert column(tree.nodes, "index") == [-9999, 1, 2, 3, 4, 1, 2, 3, 5]
    assert column(tree.nodes, "parent_id") == [None, 1, 2, 3, 4, 5, 6, 7, 5]
    assert column(tree.nodes, "mass") == [None, None, None, None, 2.5, 7.0, 7.0, 7.0, None]


@pytest.mark.parametrize("name", ["orchard", "hedge", "ranges"])
def test_round_trip(spark, tmp_path, name):
    tree = read_mtg(spark, f"{FILES}/{name}.mtg")
    assert write_mtg(tree, str(tmp_path / "out"), description=tree.header["description"]) == [f"{name}.mtg"]
    again = read_mtg(spark, str(tmp_path / "out" / "*.mtg"))
    drop = ["tree_id", "node_id", "parent_id"]
    a, b = (t.indexed.orderBy("tin").drop(*drop) for t in (tree, again))
    assert [r.asDict() for r in a.collect()] == [r.asDict() for r in b.collect()]


@pytest.mark.parametrize(
    "bad, said",
    [
        (("/$3", "$3"), "no proper link"),
        (("Shoot\t3", "Shot\t3"), "not declared"),
        (("Length\tALPHA\n", ""), "attributes"),
        (("\t1.25\t", "\tx\t"), "can't be REAL"),
        (("SYMBOL\tSCALE", "SYMBOL\tSKALE"), "header"),
        (("Shoot\tShoot,Bud\t+\t?\n", ""), "both"),
    ],
)
def test_bad_files(spark, bad, said):
    text = open(f"{FILES}/orchard.mtg").read().replace(*bad)
    with pytest.raises(Exception, match=said):
        parse_mtg(spark.createDataFrame([("f", text)], "file string, text string")).nodes.collect()


def test_spreadsheet(spark, tmp_path):
    import zipfile

    rows = [line.split("\t") for line in open(f"{FILES}/orchard.mtg").read().split("\n")]
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{esc(v)}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "p.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    tree = read_mtg(spark, str(tmp_path / "p.xlsx"))
    assert column(tree.nodes, "girth") == [None, None, None, 1.25, None, 6.0, 0.75, None, None, None]


# --- the model ----------------------------------------------------------------------------------------------
def test_node_checks(spark):
    with pytest.raises(ValueError):
        model.node(spark, "*", "A")
    with pytest.raises(ValueError):
        model.node(spark, "/", "A", scale=-1)
    with pytest.raises(TypeError):
        model.node(spark, "/", "A", attributes=[1])
    one = model.node(spark, "/", "A", None, 1, {"x": 2.0})
    two = E.add_child(one, 1, {"link": "+", "symbol": "B", "scale": 2}, {"x": 3.0})
    assert [(r.node_id, r.parent_id, r["index"], r.x) for r in two.nodes.orderBy("node_id").collect()] == [(1, None, -9999, 2.0), (2, 1, -9999, 3.0)]
    bad = spark.createDataFrame([(1, None, "?", "A", 0)], "node_id bigint, parent_id bigint, link string, symbol string, scale int")
    with pytest.raises(Exception, match="link must be"):
        model.from_nodes(bad).nodes.collect()


def test_cycle_and_missing_parent(spark):
    rows = lambda *p: spark.createDataFrame([(i + 1, x, "/", "A", 0) for i, x in enumerate(p)], "node_id bigint, parent_id bigint, link string, symbol string, scale int")
    with pytest.raises(ValueError, match="cycle"):
        model.from_nodes(rows(None, 3, 2), check=False).indexed
    with pytest.raises(Exception, match="no node"):
        model.from_nodes(rows(None, 9), check=False).indexed


def test_deep_chain(spark):
    n = 5001
    df = spark.range(1, n + 1).select(F.col("id").alias("node_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit("<").alias("link"), F.lit("Segment").alias("symbol"), F.lit(2).alias("scale"))
    from sylvaframe.operators.index import paths

    found = paths(model.from_nodes(df).nodes)
    assert found.select(F.max(F.size("path"))).head()[0] == n


def test_empty_tree(spark):
    tree = model.from_nodes(spark.createDataFrame([], "node_id bigint, parent_id bigint, link string, symbol string, scale int, x double"))
    assert tree.indexed.count() == 0
    assert Q.descendants(tree, "x").count() == 0
    assert A.nleaves(tree).count() == 0


# --- golden values ------------------------------------------------------------------------------------------
def test_branching_order(orchard):
    assert column(A.branching_order(orchard), "branching_order") == [1, 1, 1, 1, 2, 2, 1, 2, 2, 1]
    # a leaf counts 1 without its own "+"; the bud with a fruit is inner and branches
    assert column(A.branching_order(orchard, False), "branching_order") == [2, 2, 2, 2, 2, 1, 1, 1, 1, 1]


def test_total_length(orchard):
    rows = {r.start_id: r.s for r in A.subtree_agg(orchard, self=True, s=F.round(F.sum("Length"), 6)).collect()}
    assert rows[1] == 9.0 and rows[7] == 4.5


def test_descendants_and_ancestors(orchard):
    lists = {r.start_id: r.Length for r in Q.values(Q.descendants(orchard, "Length"), "Length").collect()}
    assert lists[1] == [None, None, 4.5, None, None, 3.0, 1.5, None, None]
    up = {r.start_id: r.Length for r in Q.values(Q.ancestors(orchard, "Length"), "Length", "dist").collect()}
    assert up[8] == [3.0, 4.5, None, None, None]
    assert [r.node_id for r in Q.ancestors(orchard, None, 8, symbol="Shoot", recursivity_level=1).collect()] == [7]
    assert [r.node_id for r in Q.descendants(orchard, None, 1, symbol=["Bud"]).orderBy("tin").collect()] == [5, 9]
    closure = Q.descendants(orchard.with_nodes(orchard.nodes, strategy="closure"), "Length", 4, symbol="Shoot")
    assert sorted(closure.collect()) == sorted(Q.descendants(orchard, "Length", 4, symbol="Shoot").collect())
    assert [r.node_id for r in Q.traverse(orchard, symbol=["Scene", "Tree", "Limb", "Bud"], all=False).orderBy("tin").collect()] == [1, 2, 3, 10]
    assert [r.node_id for r in Q.get_descendant(orchard, [1, 1, 1, 2]).collect()] == [7]


def test_delete_and_prune(orchard):
    tree = E.delete_node(orchard, 3)
    assert tree.nodes.count() == 9
    tree = E.delete_node(tree, 4)
    links = {r.node_id: (r.parent_id, r.link) for r in tree.nodes.collect()}
    assert links[7] == (2, "/") and links[5] == (2, "+")
    assert sorted(column(E.prune(orchard, 7).nodes, "node_id")) == [1, 2, 3, 4, 5, 6, 10]
    root = E.delete_node(orchard, 1)
    assert [r.node_id for r in root.nodes.where("parent_id is null").collect()] == [2]
    with pytest.raises(Exception, match="prune"):
        E.prune(orchard, 1).nodes.collect()
    two = E.delete_nodes(orchard, symbol=["Tree", "Limb", "Shoot"])
    with pytest.raises(Exception, match="root"):
        E.delete_node(two, 1).nodes.collect()


def test_inserts(orchard):
    new = {"link": "/", "symbol": "X", "index": 0, "scale": 1}
    top = E.insert_parent(orchard, 1, new)
    assert {r.node_id: r.parent_id for r in top.nodes.collect()}[1] == 11
    with pytest.raises(Exception, match="siblings"):
        E.insert_sibling(orchard, 1, new).nodes.collect()
    tree = E.insert_children(orchard, new, {"total": F.col("Length") * 2}, symbol="Shoot")
    assert [(r.node_id, r.parent_id, r.child_ord, r.total) for r in tree.nodes.where("symbol = 'X'").orderBy("node_id").collect()] == [(11, 8, 1, 3.0), (12, 7, 3, 6.0), (13, 4, 3, 9.0)]
    tree = E.insert_generations(orchard, new, symbol="Shoot", all=False)
    assert {r.node_id: r.parent_id for r in tree.nodes.collect()} == {1: None, 2: 1, 3: 2, 4: 3, 5: 11, 6: 5, 7: 11, 8: 7, 9: 7, 10: 2, 11: 4}
    assert A.get_classes(tree).where("SYMBOL = 'X'").count() == 1


def test_transform_forms(orchard):
    tree = C.transform(orchard, ("girth", "L"), ("L", lambda x: x * 2, "M"), (["L", "M"], lambda a, b: a + b), ("L", F.sqrt), (lambda t: F.col("index"), "i"), "L", symbol="Shoot")
    assert set(tree.attributes) >= {"L", "M", "L_M_function", "L_sqrt", "i", "girth"}
    assert column(tree.nodes.where("symbol = 'Shoot'"), "M") == [2.5, 1.5, None]
    assert column(tree.nodes.where("symbol = 'Fruit'"), "girth") == [6.0]
    assert C.select(orchard, ("Length", lambda x: x, "l"), "girth").attributes == ["girth", "l"]


def test_schema(orchard):
    with pytest.raises(ValueError):
        S.add_column(orchard, "Shoot", "Length", "double")
    tree = S.drop_column(S.add_column(orchard, ["Bud", "Leaf"], "sugar", "double", 1.0), "Shoot", "girth")
    assert tree.has("Leaf", "sugar") and not tree.has("Shoot", "girth") and tree.has("Fruit", "girth")
    with pytest.raises(ValueError):
        S.rename_column(orchard, "Shoot", "Length", "girth")
    assert S.rename_column(orchard, "Limb", "Length", "Wide") is orchard
    values, rest = C.pop(orchard, "Length", "Shoot")
    assert sorted(r.Length for r in values.collect()) == [1.5, 3.0, 4.5] and not rest.has("Shoot", "Length")


def test_tables_and_drawing(orchard):
    assert X.to_table(orchard, "Bud", sink=lambda df: df.count()) == 2
    assert X.symbol_table(orchard, "Nothing").count() == 0
    assert X.to_table(orchard, variables=["Length", "none"]).columns[-3:] == ["Length", "none", "tin"]
    with pytest.raises(TypeError):
        X.to_table(orchard, sink=3)
    vertices, edges = X.to_graph(orchard)
    assert (vertices.count(), edges.count()) == (10, 9)
    assert X.drawing(orchard, limit=3).split("\n")[-1] == "⋮"
    assert "├─ 5: +Bud1" in X.drawing(orchard)


def test_warnings_and_cache(orchard):
    with pytest.warns(UserWarning, match="Flower"):
        check_filters(orchard, symbol="Flower")
    cache = Q.NodeCache(orchard)
    assert cache.cache_nodes(symbol="Bud").count() == 2
    with pytest.raises(ValueError):
        cache.cache_nodes(symbol="Bud")
    assert [r.node_id for r in cache.traverse("symbol", symbol="Bud").collect()] == [5, 9]
    assert cache.name(1, "2") != cache.name("1", 2)
    lists = {r.start_id: r.buds for r in cache.cache_values("buds", symbol="Shoot").collect()}
    assert lists == {r.start_id: r.buds for r in cache.descendants("buds", symbol="Shoot").collect()} and lists[1] == [3, 2, 0]
    assert len(cache.kept) == 2 and cache.kept[cache.name("values", "buds", [("symbol", "Shoot")])] is cache.descendants("buds", symbol="Shoot")
    cache.kept.popitem()
    assert cache.nodes(symbol="Bud") is not None and len(cache.clean_cache()) == 1 and cache.nodes(symbol="Bud") is None


def test_cache_is_in_pre_order(orchard):
    """However the nodes lie in partitions, what is kept and what is not come in pre-order."""
    cache = Q.NodeCache(orchard.with_nodes(orchard.nodes.repartition(7, "node_id")))
    fresh = [r.node_id for r in cache.traverse("symbol").collect()]
    cache.cache_nodes()
    want = [r.node_id for r in orchard.indexed.orderBy("tree_id", "tin").collect()]
    assert fresh == want and [r.node_id for r in cache.traverse("symbol").collect()] == want


def test_equality_and_rechildren(orchard):
    assert C.trees_equal(orchard, orchard)
    changed = C.set_attribute(orchard, "girth", 9.0, F.col("node_id") == 8)
    assert [r.node_id for r in C.equal_nodes(orchard, changed).where("not equal").collect()] == [8]
    tree = E.rechildren(orchard, 4, [9, 5])
    assert {(r.node_id, r.parent_id, r.child_ord) for r in tree.nodes.where("node_id in (5, 7, 9)").collect()} == {(9, 4, 1), (5, 4, 2), (7, None, 2)}


def test_edits_of_one_of_several_trees(spark, orchard):
    """Two trees with the same ids: an edit that names a tree leaves the other as it was."""
    both = orchard.with_nodes(orchard.nodes.unionByName(orchard.nodes.withColumn("tree_id", F.lit("b"))))
    new = {"link": "/", "symbol": "X", "index": 0, "scale": 1}
    edits = [
        lambda t, **k: E.prune(t, 7, **k),
        lambda t, **k: E.delete_node(t, 4, **k),
        lambda t, **k: E.move(t, 10, 4, **k),
        lambda t, **k: E.rechildren(t, 4, [9, 5], **k),
        lambda t, **k: E.replace_child(t, 4, 1, 10, **k),
        lambda t, **k: E.insert_parent(t, 4, new, **k),
        lambda t, **k: E.insert_sibling(t, 4, new, **k),
        lambda t, **k: E.insert_child(t, 4, new, **k),
        lambda t, **k: E.insert_generation(t, 4, new, **k),
        lambda t, **k: E.attach(t, t, 4, **k)[0],
    ]
    columns = ["node_id", "parent_id", "child_ord", "link", "symbol"]
    for edit in edits:
        got = edit(both, tree_id="b").nodes
        assert sorted(got.where("tree_id <> 'b'").select(columns).collect()) == sorted(orchard.nodes.select(columns).collect())
        alone = edit(orchard).nodes.select(columns).collect()
        assert sorted(map(repr, got.where("tree_id = 'b'").select(columns).collect())) == sorted(map(repr, alone))


def test_filters_that_navigate(orchard):
    below_first = lambda t: Q.parents(t, "index").where("parent_index = 1")
    assert [r.node_id for r in Q.descendants(orchard, None, 1, where=below_first).orderBy("tin").collect()] == [4, 5, 6, 7]
    assert [r.node_id for r in Q.ancestors(orchard, None, 8, where=below_first).orderBy("dist").collect()] == [7, 4]
    assert sorted(column(E.delete_nodes(orchard, symbol="Bud", where=lambda t: Q.is_leaf(t).where("is_leaf")).nodes, "node_id")) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    tree = C.mutate(orchard, {"seen": F.lit(1)}, where=below_first)
    assert column(tree.nodes, "seen") == [None, None, None, 1, 1, 1, 1, None, None, None] and "_reached" not in tree.nodes.columns


def test_delete_bare(orchard):
    # 8 and 9 are leaves that match, and by that 7; 4 keeps the bud with its fruit
    assert column(E.delete_bare(orchard, symbol=["Shoot", "Bud"]).nodes, "node_id") == [1, 2, 3, 4, 5, 6, 10]
    assert column(E.delete_bare(orchard).nodes, "node_id") == [1]


def test_totals_are_the_aggregates(orchard):
    tree = C.mutate(orchard, {"x": (F.col("node_id") - 6) * 3})
    for own in (False, True):
        want = A.subtree_agg(tree, self=own, symbol=["Shoot", "Bud"], n=F.count(F.lit(1)), x=F.sum("x"), buds=F.sum("buds"))
        got = A.subtree_totals(tree, self=own, symbol=["Shoot", "Bud"], x="x", buds="buds")
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_long_file_in_stretches(spark, monkeypatch):
    """A file of many lines, numbered in stretches of 16: nodes and parents as in a plain walk."""
    from sylvaframe.operators import index

    monkeypatch.setattr(index, "WIDTH", 16)
    r = random.Random(4)
    lines, depth, last, want = [], 0, {}, []
    for i in range(1, 400):
        depth = r.randint(1, min(depth + 1, 6)) if i > 1 else 0
        lines.append("\t" * depth + f"{r.choice('/<+')}S{i}" + "\t" * (7 - depth) + str(i))
        want.append((i, last.get(depth - 1), i))
        last[depth] = i
    text = "CODE:\tFORM-A\nCLASSES:\nSYMBOL\tSCALE\tDECOMPOSITION\tINDEXATION\tDEFINITION\nS\t1\tFREE\tFREE\tIMPLICIT\nDESCRIPTION:\nLEFT\tRIGHT\tRELTYPE\tMAX\nFEATURES:\nNAME\tTYPE\nmass\tINT\nMTG:\nENTITY-CODE" + "\t" * 7 + "mass\n" + "\n".join(lines)
    tree = parse_mtg(spark.createDataFrame([("f", text)], "file string, text string"))
    assert [(x.node_id, x.parent_id, x.mass) for x in tree.nodes.orderBy("node_id").collect()] == want


def test_strategy_is_checked(orchard):
    with pytest.raises(ValueError):
        orchard.with_nodes(orchard.nodes, strategy="recursive")


def test_unify_widens(spark):
    a = model.node(spark, "/", "A", attributes={"x": 1})
    b = model.node(spark, "/", "A", attributes={"x": 2.5, "y": "z"}, tree_id="other")
    both = S.unify(a, b)
    assert [r.x for r in both.nodes.orderBy("tree_id").collect()] == [2.5, 1.0]
    assert both.catalog["A"].keys() == {"x", "y"}
    new, mapping = E.attach(a, model.node(spark, "+", "B", attributes={"y": 1}), 1)
    assert [(r.node_id, r.parent_id) for r in new.nodes.orderBy("node_id").collect()] == [(1, None), (2, 1)] and mapping.count() == 1


def test_from_edges(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 1, 4), ("a", 3, 1, 3)], "t string, i int, p int, w int")
    tree = from_edges(df, "i", "p", symbol=F.lit("S"), scale=F.lit(1), link=F.lit("/"), tree="t", order="w")
    assert [r.node_id for r in Q.list_nodes(tree).orderBy("tin").collect()] == [1, 3, 2]
