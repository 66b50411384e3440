"""Ways that large trees take: cut into parts, deleted by runs, without tables left over."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sylvaframe import model, storage
from sylvaframe.model import TreeFrame
from sylvaframe.operators import aggregate as A
from sylvaframe.operators import edit as E
from sylvaframe.operators import index as I

SCHEMA = "tree_id string, node_id bigint, parent_id bigint, child_ord int, link string, symbol string, scale int, x int"


def bushy(seed: int, nodes: int = 400, trees: int = 2) -> list[tuple]:
    """Trees with many branches near the root; some parents have more children than bits, and child numbers with gaps."""
    rng, rows = random.Random(seed), []
    for t in range(trees):
        kids = {}
        for n in range(1, nodes + 1):
            parent = None if n == 1 else 1 if n < 90 else rng.randrange(2, n) if rng.random() < 0.6 else n - 1
            kids[parent] = kids.get(parent, 0) + (2 if parent is not None and parent % 5 == 0 else 1)
            rows.append((f"t{t}", n, parent, kids[parent], rng.choice("/<+") if parent else "/", rng.choice("ABC"), rng.randrange(3), rng.choice([None, *range(-9, 50)])))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return model.from_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3))


def index_of(tree):
    return sorted(tuple(r) for r in tree.indexed.select("tree_id", "node_id", *I.COLUMNS).collect())


def test_trees_too_large_for_a_task_are_cut(spark, monkeypatch):
    rows = bushy(3)
    want = index_of(frame(spark, rows))
    monkeypatch.setattr(I, "LOCAL", 150)
    monkeypatch.setattr(I, "PARTS", 4)
    monkeypatch.setattr(I, "CHUNK", 30)
    monkeypatch.setattr(I, "_doubled", lambda big: pytest.fail("not cut"))
    assert index_of(frame(spark, rows)) == want


def test_index_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "work_dir", lambda spark: f"file://{tmp_path}")
    tree = frame(spark, bushy(4, 120))
    assert tree.indexed.count() == 240
    assert sorted(name.rsplit("-", 1)[0] for name in os.listdir(tmp_path)) == ["index", "index-rest"]


def deleted(rows, gone, child_link):
    """By climbing, node by node."""
    by = {(r[0], r[1]): r for r in rows}
    kept = {}
    for r in rows:
        if gone(r):
            continue
        link, key, at = r[4], [(0, r[3])], r[2]
        while at is not None and gone(by[r[0], at]):
            up = by[r[0], at]
            link, key, at = child_link(link, up[4]), [(1, up[3]), *key], up[2]
        kept.setdefault((r[0], at), []).append((key, r[1], link))
    return sorted((t, n, at, i, link) for (t, at), kin in kept.items() for i, (_, n, link) in enumerate(sorted(kin), 1)) if kept else []


@pytest.mark.parametrize("many", [False, True])
def test_deletes_by_runs_of_deleted_nodes(spark, monkeypatch, many):
    """No pairs of nodes above and below each other; also with links of which there is no end."""
    monkeypatch.setattr(TreeFrame, "pairs", lambda *a, **k: pytest.fail("pairs of nodes"))
    rows = bushy(5, 200)
    rule = (lambda c, d: F.concat(c, d)) if many else (lambda c, d: F.when(c == "<", d).otherwise(c))
    want = deleted(rows, lambda r: r[2] is not None and r[5] != "A", (lambda c, d: c + d) if many else (lambda c, d: d if c == "<" else c))
    out = E.delete_nodes(frame(spark, rows), where="parent_id is not null and symbol <> 'A'", child_link=rule).nodes
    key = lambda r: (r[0], r[1])
    assert sorted([tuple(r) for r in out.select("tree_id", "node_id", "parent_id", "child_ord", "link").collect()], key=key) == sorted(want, key=key)


def below(rows):
    kids = {}
    for r in rows:
        kids.setdefault((r[0], r[2]), []).append(r)
    return lambda r: [x for k in kids.get((r[0], r[1]), []) for x in (k, *below_of(kids, k))]


def below_of(kids, r):
    return [x for k in kids.get((r[0], r[1]), []) for x in (k, *below_of(kids, k))]


def test_from_the_leaves_up_and_from_the_roots_down(spark, monkeypatch):
    """No blocks of the pre-order and no pairs of nodes, also where a tree is many parts."""
    rows = bushy(6, 150)
    monkeypatch.setattr(I, "LOCAL", 60)
    monkeypatch.setattr(I, "CHUNK", 20)
    monkeypatch.setattr(A, "range_agg", lambda *a, **k: pytest.fail("blocks"))
    monkeypatch.setattr(TreeFrame, "pairs", lambda *a, **k: pytest.fail("pairs of nodes"))
    tree = frame(spark, rows)
    under = below(rows)
    values = {(r[0], r[1]): [x[7] for x in under(r) if x[7] is not None] for r in rows}
    want = {k: (max(v), min(v), len(set(v))) for k, v in values.items() if v}
    got = {(r.tree_id, r.start_id): (r.most, r.least, r.kinds) for r in A.subtree_ranges(tree, most=("max", "x"), least=("min", "x"), kinds=("distinct", "x")).collect() if r.most is not None}
    assert got == want
    leaves = {(r[0], r[1]): sum(1 for x in under(r) if not under(x)) for r in rows}
    assert {(r.tree_id, r.node_id): r.n_leaves for r in A.leaf_count(tree).collect()} == leaves
    by = {(r[0], r[1]): r for r in rows}
    kin = {}
    for r in rows:
        kin.setdefault((r[0], r[2]), []).append(r)

    def pipe(r):
        if r[2] is None or abs(r[7] or 0) > 30:
            return float(abs(r[7] or 0))
        beside = kin[r[0], r[2]]
        return pipe(by[r[0], r[2]]) * ((leaves[r[0], r[1]] + 1) / sum(leaves[k[0], k[1]] + 1 for k in beside) if len(beside) > 1 else 1.0)

    girth = tree.with_nodes(tree.nodes.withColumn("girth", F.abs(F.coalesce("x", F.lit(0)))), True)
    assert {(r.tree_id, r.node_id): r.pipe for r in A.pipe_model_threshold(girth, "girth", 30.0).collect()} == {(r[0], r[1]): pipe(r) for r in rows}
