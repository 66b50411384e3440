"""Random trees: the engine against a plain walk over Python objects, one operation after the other."""

import random

import pytest
from pyspark.sql import functions as F

from sylvaframe import model
from sylvaframe.functions.links import link_after
from sylvaframe.operators import aggregate as A
from sylvaframe.operators import edit as E
from sylvaframe.operators import query as Q


class N:
    def __init__(self, id, parent, link, symbol, x):
        self.id, self.parent, self.link, self.symbol, self.x, self.kids = id, parent, link, symbol, x, []
        if parent:
            parent.kids.append(self)

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


def grown(seed):
    r = random.Random(seed)
    nodes = [N(1, None, "/", "A", 5.0)]
    for i in range(2, r.randint(3, 30)):
        nodes.append(N(i, r.choice(nodes[-6:]), r.choice("/<+"), r.choice("ABC"), r.choice([None, 0.5, 2.0, 3.0, 9.0, -1.0])))
    return nodes[0]


SEEDS = range(25)


@pytest.fixture(scope="module")
def forest(spark):
    rows = []
    for seed in SEEDS:
        for n in grown(seed).walk():
            rows.append((str(seed), n.id, n.parent.id if n.parent else None, (n.parent.kids.index(n) + 1) if n.parent else 1, n.link, n.symbol, None, "ABC".index(n.symbol), n.x))
    tree = model.from_nodes(spark.createDataFrame(rows, model.TOPOLOGY_SCHEMA + ", x double"))
    tree.indexed
    return tree


def per_tree(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(int(r.tree_id), set()).add(tuple(r[c] for c in columns))
    return out


def same(df, columns, plain):
    got = per_tree(df, *columns)
    for seed in SEEDS:
        assert got.get(seed, set()) == set(plain(grown(seed))), seed


def test_orders(forest):
    def post(n):
        for k in n.kids:
            yield from post(k)
        yield n

    same(Q.list_nodes(forest), ["node_id", "tin"], lambda t: [(n.id, i + 1) for i, n in enumerate(t.walk())])
    same(Q.post_order(forest), ["node_id", "tpost"], lambda t: [(n.id, i + 1) for i, n in enumerate(post(t))])


def ok(n):
    return n.symbol != "B" and n.x is not None


@pytest.mark.parametrize("self_", [False, True])
@pytest.mark.parametrize("level", [None, 0, 1, 2])
@pytest.mark.parametrize("every", [True, False])
def test_descendants(forest, self_, level, every):
    def down(start):
        out = []

        def go(n, depth):
            if level is not None and depth > level:
                return
            if ok(n):
                out.append(n)
            elif not every:
                return
            for k in n.kids:
                go(k, depth + 1)

        if self_:
            go(start, 1)
        else:
            for k in start.kids:
                go(k, 1)
        return out

    got = Q.descendants(forest, "x", symbol=["A", "C"], all=every, self=self_, recursivity_level=level, ignore_nothing=True)
    same(got, ["start_id", "node_id", "x"], lambda t: [(s.id, n.id, n.x) for s in t.walk() for n in down(s)])


@pytest.mark.parametrize("self_", [False, True])
@pytest.mark.parametrize("level", [None, 1, 2])
@pytest.mark.parametrize("every", [True, False])
def test_ancestors(forest, self_, level, every):
    def up(start):
        out, n, kept = [], start if self_ else start.parent, 0
        if self_ and n is start:
            if ok(n):
                out.append(n)
            elif not every:
                return out
            n = n.parent
        while n is not None and (level is None or kept < level):
            if ok(n):
                out.append(n)
                kept += 1
            elif not every:
                break
            n = n.parent
        return out

    got = Q.ancestors(forest, "x", symbol=["A", "C"], all=every, self=self_, recursivity_level=level, ignore_nothing=True)
    same(got, ["start_id", "node_id", "x"], lambda t: [(s.id, n.id, n.x) for s in t.walk() for n in up(s)])


def leaves_below(n):
    return sum(not k.kids for k in n.walk() if k is not n)


def test_statistics(forest):
    def up(n):
        return 1 if n.parent is None else up(n.parent) + (n.link == "+")

    def down(n):
        return 1 if not n.kids else max(map(down, n.kids)) + (n.link == "+")

    def pipe(n):
        if n.parent is None:
            return 10.0
        share = (leaves_below(n) + 1) / sum(leaves_below(k) + 1 for k in n.parent.kids)
        return pipe(n.parent) * share

    same(A.nleaves(forest), ["node_id", "nleaves"], lambda t: [(n.id, leaves_below(n) + 1) for n in t.walk()])
    same(A.branching_order(forest), ["node_id", "branching_order"], lambda t: [(n.id, up(n)) for n in t.walk()])
    same(A.branching_order(forest, False), ["node_id", "branching_order"], lambda t: [(n.id, down(n)) for n in t.walk()])
    same(A.pipe_model(forest, 10.0).withColumn("p", F.round("pipe", 9)), ["node_id", "p"], lambda t: [(n.id, round(pipe(n), 9)) for n in t.walk()])


def test_pipe_model_with_threshold(forest):
    limit = 1.0

    def value(n):
        if n.parent is None or (n.x is not None and n.x > limit):
            return n.x
        pool, kin = value(n.parent), [k for k in n.parent.kids if k is not n]
        if not kin:
            return pool
        total, others = sum(k.x or 0.0 for k in kin), 0
        for k in kin:
            v = k.x or 0
            if v > limit and pool > v and total < v:
                pool -= v
            else:
                others += leaves_below(k) + 1
        return pool * (leaves_below(n) + 1) / (others + leaves_below(n) + 1)

    got = A.pipe_model_threshold(forest, "x", limit, allow_missing=True).withColumn("p", F.round("pipe", 9))
    same(got, ["node_id", "p"], lambda t: [(n.id, round(value(n), 9)) for n in t.walk()])
    with pytest.raises(Exception, match="x has no value"):
        A.pipe_model_threshold(forest, "x", limit).collect()


def shape(t):
    return [(n.id, n.parent.id if n.parent else None, (n.parent.kids.index(n) + 1) if n.parent else 1, n.link) for n in t.walk()]


TOPO = ["node_id", "parent_id", "child_ord", "link"]


def test_bulk_delete(forest):
    def deleted(t):
        def go(n):
            for k in list(n.kids):
                go(k)
            if n.symbol == "B" and n.parent:
                for k in n.kids:
                    k.link = link_after(k.link, n.link, False)
                    k.parent = n.parent
                    n.parent.kids.append(k)
                n.parent.kids.remove(n)

        go(t)
        return shape(t)

    same(E.delete_nodes(forest, symbol="B").nodes, TOPO, deleted)


def test_delete_segments(forest):
    def deleted(t):
        def segment(n):
            if not n.kids or n.parent is None or n.parent.parent is None or len(n.kids) != 1 or n.kids[0].link == "+":
                return False
            if n.link in "+/":
                n.kids[0].link = n.link
            return True

        def go(n):
            for k in list(n.kids):
                go(k)
            if segment(n):
                for k in n.kids:
                    k.link = link_after(k.link, n.link, False)
                    k.parent = n.parent
                    n.parent.kids.append(k)
                n.parent.kids.remove(n)

        go(t)
        return shape(t)

    same(E.delete_segments(forest).nodes, TOPO, deleted)


@pytest.mark.parametrize("kind", ["parents", "children", "siblings", "generations"])
@pytest.mark.parametrize("every", [True, False])
def test_bulk_insert(forest, kind, every):
    new = {"link": "<", "symbol": "Z", "index": 1, "scale": 3}

    def inserted(t):
        hits, last = [], max(n.id for n in t.walk())

        def match(n):
            return n.symbol == "C" and n.parent is not None

        def go(n, below):
            hit = match(n) and (every or not below)
            for k in n.kids:
                go(k, below or match(n))
            if hit:
                hits.append(n)

        go(t, False)
        places = {id(n): n.parent.kids.index(n) for n in hits}
        for n in hits:
            last += 1
            z = N(last, None, "<", "Z", None)
            if kind == "parents":
                z.parent = n.parent
                n.parent.kids.remove(n)
                n.parent.kids.append(z)
                n.parent, z.kids = z, [n]
            elif kind == "children":
                z.parent = n
                n.kids.append(z)
            elif kind == "siblings":
                z.parent = n.parent
                n.parent.kids.append(z)
            else:
                z.parent, z.kids = n, n.kids
                for k in z.kids:
                    k.parent = z
                n.kids = [z]
        return shape(t)

    made = getattr(E, f"insert_{kind}")(forest, new, where="symbol = 'C' and parent_id is not null", all=every)
    same(made.nodes, TOPO, inserted)
