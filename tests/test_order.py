"""The index, joins over pre-order and aggregates over ranges, against plain Python walks of random trees."""

import random

import pytest
from pyspark.sql import functions as F

from sylvaframe import model
from sylvaframe.operators import aggregate as A
from sylvaframe.operators import index as I
from sylvaframe.operators import query as Q

SCHEMA = "tree_id string, node_id bigint, parent_id bigint, child_ord int, link string, symbol string, scale int, x double, d decimal(12,2), k int, v string"


def forest(seed, trees=5, most=60):
    """Rows of trees: random, a chain, a star, a single root, and one with two roots."""
    r = random.Random(seed)
    rows = []
    for t in range(trees):
        n = 1 if t == 3 else r.randint(20, most)
        ids = r.sample(range(1, 10 * most), n)
        kids = {}
        for i, node in enumerate(ids):
            parent = None if i == 0 or (t == 4 and i == 5) else ids[i - 1] if t == 1 else ids[0] if t == 2 else r.choice(ids[:i])
            kids[parent] = kids.get(parent, 0) + 1
            rows.append((f"t{t}", node, parent, kids[parent], r.choice("/<+"), r.choice("ABC"), r.randint(0, 3), r.choice([None, r.uniform(-5, 5)]), None, r.choice([None, r.randint(-9, 9)]), r.choice([None, "p", "q", "r", "s"])))
    return rows


class Walk:
    """One tree, walked node by node."""

    def __init__(self, rows):
        self.row = {r[1]: r for r in rows}
        self.kids = {n: [] for n in self.row}
        for r in sorted(rows, key=lambda r: r[3]):
            if r[2] is not None:
                self.kids[r[2]].append(r[1])
        self.order, self.depth, self.size, self.root = [], {}, {}, {}
        for top in (r for r in sorted(rows, key=lambda r: r[3]) if r[2] is None):
            self.visit(top[1], 0, top[1])
        self.tin = {n: i + 1 for i, n in enumerate(self.order)}

    def visit(self, n, depth, root):
        self.order.append(n)
        self.depth[n], self.root[n] = depth, root
        self.size[n] = 1 + sum(self.visit(c, depth + 1, root) for c in self.kids[n])
        return self.size[n]

    def below(self, n):
        return self.order[self.tin[n] - 1 : self.tin[n] - 1 + self.size[n]]


def indexed(spark, most):
    """A forest, indexed by joins (``most`` is small, so all but the smallest trees are too large for a task) or by arrays."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(I, "LOCAL", most)
        patch.setattr(I, "CHUNK", 25)
        rows = forest(7)
        tree = model.from_nodes(spark.createDataFrame(rows, SCHEMA).withColumn("d", F.col("x").cast("decimal(12,2)")).repartition(3))
        tree.indexed
    return tree, {t: Walk([r for r in rows if r[0] == t]) for t in sorted({r[0] for r in rows})}


@pytest.fixture(scope="module")
def made(spark):
    return indexed(spark, 1 << 20)


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_index_and_folds(spark, monkeypatch, most):
    tree, walks = indexed(spark, most)
    got = {(r.tree_id, r.node_id): (r.root_id, r.depth, r.n_children, r.is_leaf, r.size, r.tin, r.tout) for r in tree.indexed.collect()}
    want = {(t, n): (w.root[n], w.depth[n], len(w.kids[n]), not w.kids[n], w.size[n], w.tin[n], w.tin[n] + w.size[n] - 1) for t, w in walks.items() for n in w.order}
    assert got == want
    monkeypatch.setattr(I, "LOCAL", most)
    check_pipe(tree, walks)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("narrow", [False, True])
def test_pairs(monkeypatch, made, own, narrow):
    """Also where bins are so narrow that ranges need wider ones."""
    tree, walks = made
    if narrow:
        monkeypatch.setattr(I, "BIN", 2)
        monkeypatch.setattr(I, "WIDER", 3)
        monkeypatch.setattr(I, "MOST_BINS", 2)
    want = sorted((t, a, n, w.depth[n] - w.depth[a]) for t, w in walks.items() for a in w.order for n in w.below(a) if own or n != a)
    for t in (tree, tree.with_nodes(tree.nodes, True, strategy="closure")):
        got = t.pairs(t.indexed, t.indexed, own, upper=["symbol"], lower=["tin"])
        assert sorted(tuple(r) for r in got.select("tree_id", "anc_id", "node_id", "dist").collect()) == want
    some = tree.pairs(tree.indexed.where("symbol = 'A'"), tree.indexed.where("symbol = 'B'"), own, most=2)
    assert sorted(tuple(r) for r in some.collect()) == [p for p in want if p[3] <= 2 and walks[p[0]].row[p[1]][5] == "A" and walks[p[0]].row[p[2]][5] == "B"]


def brute_ranges(walks, own, symbol, value):
    out = {}
    for t, w in walks.items():
        for n in w.order:
            rows = [w.row[x] for x in w.below(n) if (own or x != n) and w.row[x][5] in symbol]
            if rows:
                out[t, n] = value(rows)
    return out


def some(fn, values):
    values = [v for v in values if v is not None]
    return fn(values) if values else None


@pytest.mark.parametrize("own", [True, False])
def test_ranges(made, own):
    tree, walks = made
    got = A.subtree_ranges(tree, None, own, symbol=["A", "B"], most=("max", "k"), least=("min", "x"), total=("sum", "k"), kinds=("distinct", "v"))
    want = brute_ranges(walks, own, "AB", lambda rows: (some(max, [r[9] for r in rows]), some(min, [r[7] for r in rows]), some(sum, [r[9] for r in rows]), len({r[10] for r in rows} - {None})))
    assert {(r.tree_id, r.start_id): (r.most, r.least, r.total, r.kinds) for r in got.collect()} == want


@pytest.mark.parametrize("own", [True, False])
def test_totals_of_fractions(made, own):
    """Doubles keep their fractions, decimals are exact, and other columns are refused."""
    tree, walks = made
    got = {(r.tree_id, r.start_id): r for r in A.subtree_totals(tree, own, symbol="A", x="x", d="d", k="k").collect()}
    want = brute_ranges(walks, own, "A", lambda rows: (len(rows), some(sum, [r[7] for r in rows]), some(sum, [r[9] for r in rows])))
    assert got.keys() == want.keys()
    for key, (n, x, k) in want.items():
        assert got[key].n == n and got[key].k == k and got[key].x == (x if x is None else pytest.approx(x, rel=1e-12, abs=1e-12))
    agg = A.subtree_agg(tree, None, own, symbol="A", d=F.sum("d"))
    assert {(r.tree_id, r.start_id): r.d for r in agg.collect()} == {key: r.d for key, r in got.items()}
    with pytest.raises(TypeError):
        A.subtree_totals(tree, v="v")
    with pytest.raises(TypeError):
        Q.sibling_totals(tree, x="x")


def test_fraction_is_kept(spark):
    rows = [("t", 1, None, 1, "/", "A", 0, None, None, None, None), *[("t", i, 1, i, "/", "L", 1, 2.5 + i / 4, None, None, None) for i in (2, 3)]]
    tree = model.from_nodes(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in A.subtree_totals(tree, symbol="L", x="x").collect()] == [("t", 1, 2, 6.25)]


def test_siblings_in_stretches(monkeypatch, made):
    tree, walks = made
    monkeypatch.setattr(I, "WIDTH", 4)
    for fn, step in ((Q.next_sibling, 1), (Q.previous_sibling, -1)):
        want = {}
        for t, w in walks.items():
            for n, r in w.row.items():
                kin = w.kids[r[2]] if r[2] is not None else [n]
                at = kin.index(n) + step
                want[t, n] = kin[at] if 0 <= at < len(kin) else None
        assert {(r.tree_id, r.node_id): r.sibling_id for r in fn(tree).collect()} == want
    last = {(r.tree_id, r.node_id): r.sibling_id for r in Q.last_sibling(tree).collect()}
    assert last == {(t, n): w.kids[r[2]][-1] if r[2] is not None else None for t, w in walks.items() for n, r in w.row.items()}


def test_branching_order_down(made):
    tree, walks = made

    def order(w, n):
        if not w.kids[n]:
            return 1
        return max(order(w, c) for c in w.kids[n]) + (w.row[n][4] == "+")

    got = {(r.tree_id, r.node_id): r.branching_order for r in A.branching_order(tree, False).collect()}
    assert got == {(t, n): order(w, n) for t, w in walks.items() for n in w.order}


def check_pipe(tree, walks):
    got = {(r.tree_id, r.node_id): r.pipe for r in A.pipe_model(tree, 10.0).collect()}
    for t, w in walks.items():

        def leaves(n, w=w):
            return sum(not w.kids[x] for x in w.below(n) if x != n) + 1

        for n in w.order:
            value, at = 10.0, n
            while w.row[at][2] is not None:
                value *= leaves(at) / sum(map(leaves, w.kids[w.row[at][2]]))
                at = w.row[at][2]
            assert got[t, n] == pytest.approx(value, rel=1e-12)


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_faults(spark, monkeypatch, most):
    monkeypatch.setattr(I, "LOCAL", most)
    rows = lambda *p: spark.createDataFrame([(i, x, "/", "A", 0) for i, x in p], "node_id bigint, parent_id bigint, link string, symbol string, scale int")
    with pytest.raises(ValueError, match="cycle"):
        model.from_nodes(rows((1, None), (2, 5), (3, 2), (4, 3), (5, 4)), check=False).indexed
    with pytest.raises(Exception, match="no node"):
        model.from_nodes(rows((1, None), (2, 1), (3, 99), (4, 3), (5, 4), (6, 5)), check=False).indexed
    with pytest.raises(Exception, match="two nodes"):
        model.from_nodes(rows((1, None), (2, 1), (2, 1)), check=False).indexed


def test_chain_of_a_hundred_thousand(spark, monkeypatch):
    """Rounds hold a row for each node, no paths."""
    n = 100_000
    monkeypatch.setattr(I, "LOCAL", 1000)
    df = spark.range(1, n + 1).select(F.col("id").alias("node_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit("<").alias("link"), F.lit("S").alias("symbol"), F.lit(2).alias("scale"))
    found = model.from_nodes(df).indexed
    assert found.where("tin <> node_id or depth <> node_id - 1 or size <> 100001 - node_id or root_id <> 1").count() == 0 and found.count() == n
