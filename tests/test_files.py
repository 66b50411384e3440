"""Files by any path, many at once, split files, and writes that lose nothing."""

import os
import random

import pytest
from conftest import FILES
from pyspark.sql import functions as F

from sylvaframe.operators import convert as X
from sylvaframe.operators import query as Q
from sylvaframe.sources.mtg_text import numbered_lines, read_mtg, write_mtg

HEAD = "CODE:\tFORM-A\n\nCLASSES:\nSYMBOL\tSCALE\tDECOMPOSITION\tINDEXATION\tDEFINITION\n$\t0\tFREE\tFREE\tIMPLICIT\nA\t1\tFREE\tFREE\tIMPLICIT\n\nFEATURES:\nNAME\tTYPE\nLength\tREAL\n\nMTG:\nENTITY-CODE"


def text(n, seed=0):
    """A file of n nodes in up to 6 columns, with lengths, comments and blank lines."""
    r = random.Random(seed)
    out, column = [HEAD + "\t" * 6 + "Length"], 0
    for i in range(n):
        column = 0 if i == 0 else r.randint(1, min(column + 1, 5))
        out.append("\t" * column + ("/" if i == 0 else r.choice("<+/")) + f"A{i}" + "\t" * (6 - column) + f"{i / 4}" + r.choice(["", "  # told", "\n"]))
    return "\n".join(out) + "\n"


@pytest.fixture
def folders(tmp_path):
    for name, n in (("a/plant.mtg", 10), ("b/plant.mtg", 12), ("b/c/other one.mtg", 5), ("b/c/50%.mtg", 3)):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text(n, n))
    return str(tmp_path / "in")


def counts(tree):
    return {r.tree_id: r["count"] for r in tree.nodes.groupBy("tree_id").count().collect()}


def test_one_name_in_two_folders(spark, folders):
    """Two files of one base name are two trees."""
    tree = read_mtg(spark, folders, recursive=True)
    got = counts(tree)
    plants = sorted(t for t in got if t.endswith("plant.mtg"))
    assert [p.split("/in/")[1] for p in plants] == ["a/plant.mtg", "b/plant.mtg"]
    assert [got[p] for p in plants] == [10, 12] and got["other one.mtg"] == 5 and got["50%.mtg"] == 3
    one = read_mtg(spark, f"{folders}/a")
    assert counts(one) == {"plant.mtg": 10}
    below = Q.descendants(tree).where(f"tree_id = '{plants[0]}'").count()
    assert below == Q.descendants(one).count()


@pytest.mark.parametrize("names", ["path", "base", "stem"])
def test_all_files_come_back(spark, folders, tmp_path, names):
    tree = read_mtg(spark, folders, names, recursive=True)
    written = write_mtg(tree, str(tmp_path / "out"))
    assert sorted(f for f in os.listdir(tmp_path / "out") if not f.startswith(".")) == written and len(written) == 4
    again = read_mtg(spark, str(tmp_path / "out"), "stem")
    strip = lambda t: t.removesuffix(".mtg")
    assert counts(again) == {strip(t): n for t, n in counts(tree).items()}
    columns = ["node_id", "parent_id", "child_ord", "link", "symbol", "index", "Length"]
    rows = lambda t: sorted((strip(r.tree_id), *map(str, r[1:])) for r in t.nodes.select("tree_id", *columns).collect())
    assert rows(again) == rows(tree)


def test_odd_names(spark, folders, tmp_path):
    one = read_mtg(spark, f"{folders}/a", "stem")
    names = ["x", "y/z", "y:z", "y%2Fz", ".hidden", "_hidden", "with space", "é+=&", "a\\b", "%"]
    nodes = None
    for n in names:
        rows = one.nodes.withColumn("tree_id", F.lit(n))
        nodes = rows if nodes is None else nodes.union(rows)
    write_mtg(one.with_nodes(nodes), str(tmp_path / "out"))
    assert counts(read_mtg(spark, str(tmp_path / "out"), "stem")) == dict.fromkeys(names, 10)


def test_two_trees_of_one_file(spark, folders, tmp_path):
    """``x`` beside ``x.mtg``: nothing is written."""
    one = read_mtg(spark, f"{folders}/a")
    both = one.with_nodes(one.nodes.withColumn("tree_id", F.lit("x")).union(one.nodes.withColumn("tree_id", F.lit("x.mtg"))))
    with pytest.raises(ValueError, match="share the file x.mtg"):
        write_mtg(both, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")
    write_mtg(one, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        write_mtg(one, str(tmp_path / "out"))


def test_failed_write_leaves_no_file(spark, folders, tmp_path):
    one = read_mtg(spark, f"{folders}/a")
    one.indexed
    broken = one.with_nodes(one.nodes.withColumn("Length", F.when(F.col("node_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("Length"))), True)
    with pytest.raises(Exception, match="lost"):
        write_mtg(broken, str(tmp_path / "out"), features=[("Length", "REAL")])
    assert [f for _, _, files in os.walk(tmp_path / "out") for f in files if f.endswith(".mtg")] == []


def test_a_file_in_many_splits(spark, tmp_path):
    """Lines keep their numbers, and trees their nodes, however a file is split."""
    for name, n in (("big.mtg", 1500), ("small.mtg", 4)):
        (tmp_path / name).write_text(text(n, 3))
    whole = read_mtg(spark, str(tmp_path)).nodes.collect()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        lines = numbered_lines(spark, [str(tmp_path)])
        got = {}
        for r in lines.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.n, r.line))
        for name, rows in got.items():
            assert [line for _, line in sorted(rows)] == (tmp_path / name).read_text().split("\n")[:-1]
            assert sorted(n for n, _ in rows) == list(range(len(rows)))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        split = read_mtg(spark, str(tmp_path)).nodes.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(map(str, split)) == sorted(map(str, whole)) and len(whole) == 1504


def test_drawn_again(spark, tmp_path):
    tree = read_mtg(spark, f"{FILES}/orchard.mtg")
    write_mtg(tree, str(tmp_path / "out"))
    again = read_mtg(spark, str(tmp_path / "out"))
    assert X.drawing(again, limit=100) == X.drawing(tree, limit=100)
