"""Sums over siblings without their pairs: crowded parents against plain loops."""

import random

from conftest import TESTDATA
from pyspark.sql import functions as F

from sylvaframe import model
from sylvaframe.operators import aggregate as A
from sylvaframe.operators import index
from sylvaframe.operators import query as Q
from sylvaframe.plans.registry import QUERIES
from sylvaframe.plans.sample_trees import sales_tree


def star(spark, values):
    """A root of 5.0 with a child for each value, and two leaves under every third child."""
    rows = [("t", 1, None, 1, "/", "A", None, 0, 1000.0)]
    for i, v in enumerate(values):
        rows.append(("t", 10 + i, 1, i + 1, "<", "B", None, 1, v))
        if i % 3 == 0:
            rows += [("t", 10_000_000 + 2 * i + k, 10 + i, k + 1, "+", "C", None, 2, x) for k, x in enumerate((None, 0.1))]
    return model.from_nodes(spark.createDataFrame(rows, model.TOPOLOGY_SCHEMA + ", x double")), rows


def plain(rows, limit):
    kids, out = {}, {1: 1000.0}
    for r in rows[1:]:
        kids.setdefault(r[2], []).append(r)
    leaves = {r[1]: 1 + len(kids.get(r[1], [])) for r in rows}
    for parent in (1, *sorted(k for k in kids if k != 1)):
        for r in kids[parent]:
            if r[8] is not None and r[8] > limit:
                out[r[1]] = r[8]
                continue
            kin, pool, others = [k for k in kids[parent] if k is not r], out[parent], 0
            total = sum(k[8] or 0.0 for k in kin)
            for k in kin:
                v = k[8] or 0.0
                if v > limit and pool > v and total < v:
                    pool -= v
                else:
                    others += leaves[k[1]]
            out[r[1]] = pool if not kin else pool * (leaves[r[1]] / (others + leaves[r[1]]))
    return out


def test_threshold_model_on_crowded_parents(spark, monkeypatch):
    monkeypatch.setattr(index, "WIDTH", 16)
    r = random.Random(5)
    for values in ([r.choice([None, 0.1, 0.2, 0.3, 7.0, 40.0]) for _ in range(300)], [r.choice([None, 0.1, -3.0, -0.7, 7.0, 40.0]) for _ in range(300)], [0.3, 0.1], [-0.5, 7.0, 0.1], [-200.0, 600.0, 300.0, 0.2, 90.0]):
        tree, rows = star(spark, values)
        got = {x.node_id: x.pipe for x in A.pipe_model_threshold(tree, "x", 1.0, allow_missing=True).collect()}
        want = plain(rows, 1.0)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_no_list_of_all_siblings_on_each_sibling(spark):
    """One parent of 6,000: a list of all siblings on every node of a path would have 36,000,000 entries."""
    tree, rows = star(spark, [0.5] * 6000)
    plan = A.pipe_model_threshold(tree, "x", 1.0, allow_missing=True)._jdf.queryExecution().toString()
    assert "windowspecdefinition" not in plan
    n = {x.node_id: x.sum_siblings for x in A.sum_siblings(tree).collect()}
    total = 6000 + 2 * 2000
    assert n[1] == 0 and n[10] == total - 3 and n[11] == total - 1
    assert "collect_list" not in A.sum_siblings(tree)._jdf.queryExecution().toString()


def test_sibling_totals(spark):
    sf = f"{TESTDATA}/sf0.001"
    tree = sales_tree(spark, sf)
    pairs = Q.siblings(tree).join(tree.nodes.select("tree_id", F.col("node_id").alias("sibling_id"), "cents"), ["tree_id", "sibling_id"])
    want = {(r.node_id, r.n, r.total, r.cents) for r in pairs.groupBy("node_id").agg(F.count("*").alias("n"), F.sum("sibling_id").alias("total"), F.sum("cents").alias("cents")).collect()}
    got = {(r.node_id, r.n, r.total, r.cents) for r in QUERIES["siblings"](spark, sf).collect()}
    assert got == want
    kinds = {r.symbol for r in tree.nodes.where(F.col("node_id").isin([x[0] for x in got])).select("symbol").distinct().collect()}
    assert {"Customer", "Region"} <= kinds
