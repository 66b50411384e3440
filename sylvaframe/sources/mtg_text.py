"""Reader and writer of the tab-separated ``.mtg`` text format.

Many files are read at once, one tree each. Spark's text source splits large files; lines are numbered by the block of bytes that they come from and their place in it, node numbers and parents
are found in stretches of lines that follow each other, attributes from the feature names of a file's header, so that
no text file is one row or one task. Nothing but the distinct feature names and symbols comes to the driver.

The writer lets Spark commit one text file a tree in a hidden folder and then moves the files to their names: a write that is killed leaves no half file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NO_INDEX, TreeFrame
from ..operators.index import last_before, path_sums, sent, sum_before
from ..operators.schema import widened
from ..storage import packed

#: Section names, table headers and column types of the format (fixed values).
SECTIONS = ("CODE", "CLASSES", "DESCRIPTION", "FEATURES", "MTG")
CLASSES = ["SYMBOL", "SCALE", "DECOMPOSITION", "INDEXATION", "DEFINITION"]
DESCRIPTION = ["LEFT", "RIGHT", "RELTYPE", "MAX"]
FEATURES = ["NAME", "TYPE"]
RANGES = ("<", "<.", "+", "+.")
NO_ATTRIBUTES = 50  # first attribute column of a file without features
_BLANKS = " \t\r\f\x0b"


def _error(*parts) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def strip_comments(line: Column) -> Column:
    """What stands before ``#`` or ``;``, without blanks at the end."""
    return F.rtrim(F.regexp_replace(line, "[#;].*", ""), F.lit(_BLANKS))


def is_section(line: Column, name: str = "|".join(SECTIONS)) -> Column:
    return line.rlike(f"^({name})[ \\t]*:")


def split_elements(cell: Column) -> Column:
    """``^/A1<B2`` as ``^``, ``/A1``, ``<B2``."""
    return F.split(cell, "(?<=.)(?=[</+])")


def parse_code(code: Column) -> tuple[Column, Column, Column]:
    """Link, symbol and index (-9999 without one) of an element."""
    pattern = "^([</+])(.*?)([0-9]*)$"
    index = F.regexp_extract(code, pattern, 3)
    return F.regexp_extract(code, pattern, 1), F.regexp_extract(code, pattern, 2), F.when(index == "", NO_INDEX).otherwise(index.try_cast("int"))


def expand_elements(elements: Column, where: Column) -> Column:
    """Structs (code, shared): ``/U1<<U4`` gives U2 and U3, too; with ``<.<`` or ``+.+`` all of the range share the attributes."""
    kind = "array<struct<code:string,shared:boolean>>"

    def one(x, i):
        before, after = F.get(elements, i - 1), F.get(elements, i + 1)
        _, symbol, first = parse_code(before)
        _, other, last = parse_code(after)
        new = F.transform(F.sequence(first + 1, F.greatest(last - 1, first + 1)), lambda k: F.struct(F.concat(F.substring(x, 1, 1), symbol, k.cast("string")).alias("code"), (F.length(x) > 1).alias("shared")))
        bad = _error("symbols before and after a range differ in line ", where).cast(kind)
        filled = F.when(symbol.isNull() | other.isNull() | (symbol != other), bad).when(last - 1 < first + 1, F.array().cast(kind)).otherwise(new.cast(kind))
        shared = F.coalesce(before.isin("<.", "+.") | after.isin("<.", "+."), after.isin("<.", "+."), before.isin("<.", "+."), F.lit(False))
        return F.when(x.isin(*RANGES), filled).otherwise(F.array(F.struct(x.alias("code"), shared.alias("shared"))).cast(kind))

    return F.flatten(F.transform(elements, one))


def _lines(rows: DataFrame) -> DataFrame:
    """(file, n, line, section, marker): cleaned lines with their section. ``rows`` has file, n and line."""
    rows = rows.withColumn("line", strip_comments(F.regexp_replace("line", "missing", "")))
    name = F.regexp_extract("line", f"^({'|'.join(SECTIONS)})[ \\t]*:", 1)
    rows = rows.withColumn("name", name).withColumn("marker", F.col("name") != "")
    marks = rows.where("marker").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("marks"))  # a few for each file
    before = F.filter("marks", lambda m: m.n <= F.col("n"))
    section = F.get(before, F.size(before) - 1)["name"]
    return rows.join(sent(marks), "file", "left").withColumn("section", section).where("line <> ''").drop("marks", "name")


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda x: F.trim(x))


def _table(lines: DataFrame, section: str, header: list[str], empty: bool) -> DataFrame:
    """Per file the rows of a header section as an array of cell arrays, after checking its header."""
    got = lines.where((F.col("section") == section) & ~F.col("marker")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", _cells(F.col("line")).alias("c")))).alias("r"))
    head = F.slice(F.get("r", F.lit(0)).c, 1, len(header))
    rows = F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x.c)
    wrong = (head != F.array(*map(F.lit, header))) if empty else (head != F.array(*map(F.lit, header))) | (F.size("r") < 2)
    return got.select("file", F.when(wrong, _error(f"the header of section {section} must be {' '.join(header)}, with rows below, in ", F.col("file")).cast("array<array<string>>")).otherwise(rows).alias(section))


def _typed(value: Column, kind: str, name: str) -> tuple[Column, T.DataType]:
    if kind == "INT":
        out, t = value.try_cast("bigint"), T.LongType()
    elif kind == "REAL" or kind == "ALPHA" and name in ("Width", "Length"):
        out, t = value.try_cast("double"), T.DoubleType()
    elif kind == "BOOLEAN":
        out, t = value.try_cast("boolean"), T.BooleanType()
    elif kind == "DD/MM/YY":
        out, t = F.try_to_date(value, "d/M/y"), T.DateType()
    else:
        return value, T.StringType()
    return F.when(value.isNotNull() & out.isNull(), _error(f"{name} can't be {kind}: ", value).cast(t)).otherwise(out), t


def read_mtg(spark: SparkSession, paths, tree_names: str = "base", sheet_name: str | None = None, recursive: bool = False) -> TreeFrame:
    """Read ``.mtg`` files (or tab-separated text by any name; ``.xlsx`` and ``.xlsm`` by their first sheet, or the one named); ``recursive``
    reads all files of folders and the folders in them.

    ``tree_id`` is the file's name, or its whole path with ``tree_names="path"``, or with ``tree_names="stem"`` what ``write_mtg`` was given: the name without ``.mtg``, its
    escapes undone. Files that share a name in different folders are told apart by their paths.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if all(p.lower().endswith((".xlsx", ".xlsm")) for p in paths):
        from .spreadsheet import sheets_as_text

        return parse_mtg(sheets_as_text(spark, paths, sheet_name), tree_names)
    return parse_lines(numbered_lines(spark, paths, recursive), tree_names)


def numbered_lines(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(file, n, line): the lines of text files, numbered from 0 in each, read in as many splits as Spark makes of the files.

    A split has lines in order, so a line's number is its place in its split after the lines of the splits before.
    """
    text = spark.read.options(recursiveFileLookup=recursive, lineSep="\n").text(paths)
    here = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = packed(text.select(*here, F.col("value").alias("line")), "mtg-text")  # the numbers are given once
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = blocks.select("file", "block", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("_start")).alias("n"), "line")


#: Characters that a file's name can't hold, or that Spark would split or hide it by.
_ESCAPES = {"%": "%25", "/": "%2F", "\\": "%5C", ":": "%3A"}
_HIDDEN = {".": "%2E", "_": "%5F"}
SUFFIX = ".mtg"


def file_name(tree_id: Column) -> Column:
    """A name for a tree's file, different for different trees that end alike in ``.mtg`` or not."""
    name = tree_id
    for sign, code in _ESCAPES.items():
        name = F.replace(name, F.lit(sign), F.lit(code))
    for sign, code in _HIDDEN.items():
        name = F.when(name.startswith(sign), F.concat(F.lit(code), F.substring(name, F.lit(2), F.length(name)))).otherwise(name)
    return F.when(name.endswith(SUFFIX), name).otherwise(F.concat(name, F.lit(SUFFIX)))


def tree_name(name: Column) -> Column:
    """The tree whose file has a name, without ``.mtg``."""
    name = F.regexp_replace(name, "\\.mtg$", "")
    for sign, code in reversed([*_ESCAPES.items(), *_HIDDEN.items()]):
        name = F.replace(name, F.lit(code), F.lit(sign))
    return name


def _tree_ids(heads: DataFrame, tree_names: str) -> DataFrame:
    """``heads`` with the ``tree_id`` of each file."""
    base = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    if tree_names == "path":
        return heads.withColumn("tree_id", F.col("file"))
    if tree_names not in ("base", "stem"):
        raise ValueError("tree_names must be base, stem or path")
    named = heads.withColumn("_name", tree_name(base) if tree_names == "stem" else base)
    shared = named.groupBy("_name").agg(F.count(F.lit(1)).alias("_files")).where("_files > 1")
    return named.join(shared, "_name", "left").withColumn("tree_id", F.when(F.col("_files").isNull(), F.col("_name")).otherwise(F.col("file"))).drop("_name", "_files")


def parse_mtg(files: DataFrame, tree_names: str = "base") -> TreeFrame:
    """Parse whole files given as rows (file, text)."""
    return parse_lines(files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line")), tree_names)


def parse_lines(rows: DataFrame, tree_names: str = "base") -> TreeFrame:
    """Parse files given as numbered lines (file, n, line); the numbers need not follow each other closely."""
    lines = packed(_lines(rows.select("file", F.col("n").cast("bigint").alias("n"), "line")), "mtg-lines")
    heads = _table(lines, "CLASSES", CLASSES, False).join(_table(lines, "FEATURES", FEATURES, True), "file", "left").join(_table(lines, "DESCRIPTION", DESCRIPTION, True), "file", "left")
    body = lines.where((F.col("section") == "MTG") & ~F.col("marker"))
    first = body.groupBy("file").agg(F.min("n").alias("first_n"), F.min_by("line", "n").alias("body_head"))
    names = F.transform(F.coalesce("FEATURES", F.array().cast("array<array<string>>")), lambda r: F.get(r, F.lit(0)))
    kinds = F.transform(F.coalesce("FEATURES", F.array().cast("array<array<string>>")), lambda r: F.get(r, F.lit(1)))
    heads = rows.select("file").distinct().join(heads, "file", "left").join(first, "file", "left").withColumns({"names": names, "kinds": kinds})
    cells = _cells(F.col("body_head"))
    told = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), lambda x: x != "")
    start = F.array_position(F.transform(cells, lambda x, i: (i > 0) & (x != "")), F.lit(True)).cast("int")
    problem = (
        F.when(F.col("CLASSES").isNull() | F.col("body_head").isNull(), F.lit("no CLASSES or no MTG section in "))
        .when(~F.get(cells, F.lit(0)).isin("ENTITY-CODE", "TOPO"), F.lit("the MTG section must begin with ENTITY-CODE or TOPO in "))
        .when(~F.coalesce(told == F.col("names"), F.lit(False)), F.lit("the attributes of the MTG section must be those of FEATURES in "))
        .when((F.size(F.coalesce("DESCRIPTION", F.array())) > 0) & ~(F.exists("DESCRIPTION", lambda r: F.get(r, F.lit(2)) == "+") & F.exists("DESCRIPTION", lambda r: F.get(r, F.lit(2)) == "<")), F.lit("DESCRIPTION must have both + and < in "))
    )
    heads = _tree_ids(heads, tree_names)
    heads = heads.withColumn("attr_start", F.when(problem.isNotNull(), _error(problem, F.col("file")).cast("int")).when(F.size("names") == 0, F.lit(NO_ATTRIBUTES)).otherwise(start))

    heads = packed(heads, "mtg-heads")  # a row for each file, asked for many times

    rows = body.join(sent(heads).select("file", "first_n", "attr_start", "names", F.col("CLASSES").alias("classes")), "file").where("n > first_n").withColumn("cells", _cells(F.col("line")))
    rows = rows.withColumn("column", F.array_position(F.transform("cells", lambda x: x != ""), F.lit(True)).cast("int"))
    line_no = F.col("n") + 1
    rows = rows.withColumn("column", F.when(F.col("attr_start") < F.col("column"), _error("a node stands behind the first attribute column, line ", line_no).cast("int")).otherwise(F.col("column")))
    values = F.slice("cells", F.col("attr_start"), F.greatest(F.size("cells") - F.col("attr_start") + 1, F.lit(0)))
    rows = rows.withColumn("values", F.when(F.size(values) > F.size("names"), _error("more columns than features in line ", line_no).cast("array<string>")).otherwise(values))
    rows = rows.withColumn("elements", split_elements(F.get("cells", F.col("column") - 1)))
    rows = rows.withColumn("caret", F.get("elements", F.lit(0)) == "^").withColumn("elements", F.filter("elements", lambda x: x != "^"))
    rows = rows.withColumn("codes", expand_elements(F.col("elements"), line_no))
    rows = sum_before(rows.withColumn("node_id", F.col("n")), ["file"], "n", F.size("codes"), "first_id").drop("node_id").withColumn("first_id", F.col("first_id") + 1)
    rows = packed(rows.withColumn("last_id", F.col("first_id") + F.size("codes") - 1).select("file", "n", "column", "caret", "values", "codes", "first_id", "last_id"), "mtg-rows")

    # a line's parent: the last node before it in the same column (after ^) or in the one before
    carried = ["values", "codes", "first_id"]
    asks = rows.select("file", F.when(F.col("caret"), F.col("column")).otherwise(F.col("column") - 1).alias("key"), (F.col("n") * 2).alias("at"), F.lit(None).cast("bigint").alias("last_id"), *carried)
    tells = rows.select("file", F.col("column").alias("key"), (F.col("n") * 2 + 1).alias("at"), "last_id")
    met = last_before(asks.unionByName(tells, allowMissingColumns=True), ["file", "key"], "at", "last_id", "above").where("at % 2 = 0")
    rows = met.select("file", (F.col("at") / 2).cast("bigint").alias("n"), "above", *carried)

    nodes = rows.join(sent(heads).select("file", F.col("CLASSES").alias("classes")), "file").select("*", F.posexplode("codes").alias("pos", "e"))
    link, symbol, index = parse_code(F.col("e.code"))
    nodes = nodes.withColumns({"link": link, "symbol": F.when(symbol == "$", "Scene").otherwise(symbol), "index": index, "node_id": (F.col("first_id") + F.col("pos")).cast("bigint")})
    top = F.when(F.col("node_id") == 1, F.lit(None)).when(F.col("above").isNull(), _error("no parent for the node of line ", line_no).cast("bigint")).otherwise(F.col("above"))
    scale = F.get(F.transform(F.filter("classes", lambda r: F.when(F.get(r, F.lit(0)) == "$", "Scene").otherwise(F.get(r, F.lit(0))) == F.col("symbol")), lambda r: F.get(r, F.lit(1)).cast("int")), F.lit(0))
    nodes = nodes.withColumns(
        {
            "link": F.when(F.col("link") == "", _error("no proper link in line ", line_no)).otherwise(F.col("link")),
            "parent_id": F.when(F.col("pos") == 0, top).otherwise(F.col("node_id") - 1).cast("bigint"),
            "scale": F.when(scale.isNull(), _error(F.col("symbol"), " is not declared in CLASSES, line ", line_no).cast("int")).otherwise(scale),
            "parent_key": F.when(F.col("pos") == 0, F.coalesce(top, F.lit(0))).otherwise(F.col("node_id") - 1).cast("bigint"),
            "has": (F.col("pos") == F.size("codes") - 1) | F.col("e.shared"),
        }
    )
    nodes = nodes.drop("codes", "classes", "e", "above", "first_id", "pos")
    nodes = sum_before(nodes, ["file", "parent_key"], "node_id", F.lit(1), "child_ord").withColumn("child_ord", (F.col("child_ord") + 1).cast("int"))

    features = [(r.n, r.t) for r in heads.select(F.explode(F.arrays_zip(F.col("names").alias("n"), F.col("kinds").alias("t"))).alias("x")).select("x.n", "x.t").distinct().orderBy("n", "t").collect()]
    columns, kinds_of = {}, {}
    for name in dict.fromkeys(n for n, _ in features):
        raw = F.nullif(F.nullif(F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1), F.lit("")), F.lit("NA"))
        own = [t for n, t in features if n == name]
        parts = [_typed(raw, t, name) for t in own]
        kind = parts[0][1]
        for _, t in parts[1:]:
            kind = widened(kind, t)
        of_file = F.element_at(F.map_from_arrays("names", "kinds"), F.lit(name))
        value = F.lit(None).cast(kind)
        for t, (c, _) in zip(own, parts):
            value = F.when(of_file == t, c.cast(kind)).otherwise(value)
        columns[name] = F.when(F.col("has"), value)
        kinds_of[name] = kind
    nodes = nodes.join(sent(heads).select("file", "names", "kinds", "tree_id"), "file")
    nodes = nodes.select("tree_id", "node_id", "parent_id", "child_ord", "link", "symbol", "index", "scale", *[c.alias(a) for a, c in columns.items()])
    first_file = heads.select("names").where("size(names) > 0").limit(1).collect()
    if first_file:  # attributes in the order of the first header
        known = [n for n in first_file[0].names if n in columns]
        nodes = nodes.select(*nodes.columns[:8], *known, *[c for c in columns if c not in known])
    declared = heads.select(F.explode("CLASSES").alias("c")).select(F.when(F.get("c", F.lit(0)) == "$", "Scene").otherwise(F.get("c", F.lit(0))).alias("symbol"), F.get("c", F.lit(1)).cast("int").alias("scale")).distinct().collect()
    description = heads.where(F.size("DESCRIPTION") > 0).select("tree_id", F.explode("DESCRIPTION").alias("d")).select("tree_id", *[(F.split(F.get("d", F.lit(i)), ",") if c == "RIGHT" else F.get("d", F.lit(i))).alias(c) for i, c in enumerate(DESCRIPTION)])
    header = {"symbols": sorted({r.symbol for r in declared}), "scales": sorted({r.scale for r in declared}), "description": description}
    nodes = packed(nodes, "mtg-nodes")  # parsed once, whatever is asked of the tree
    filled = nodes.groupBy("symbol").agg(*[F.count(a).alias(a) for a in columns], F.count(F.lit(1)).alias("_n")).collect()
    return TreeFrame(nodes, {r["symbol"]: {a: k for a, k in kinds_of.items() if r[a]} for r in filled}, header)


def mtg_lines(tree, classes: DataFrame | None = None, features: list[tuple[str, str]] | None = None, description: DataFrame | None = None) -> DataFrame:
    """(tree_id, section, seq, line): the lines of every tree's file, in order of section and seq.

    A node stands one column further right than its parent unless it is the last child, which refers to the column above by ``^``.
    """
    from ..operators.aggregate import get_features

    features = [(r.NAME, r.TYPE) for r in get_features(tree).collect()] if features is None else list(features)
    rows = tree.indexed
    last = F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy(F.desc("child_ord"))) == 1
    marked = rows.withColumn("_last", F.col("parent_id").isNull() | last)
    lead = path_sums(marked, F.when(F.col("_last"), 0).otherwise(1), "lead").withColumn("lead", F.col("lead").cast("int"))
    body = marked.join(lead, ["tree_id", "node_id"]).join(lead.groupBy("tree_id").agg(F.max("lead").alias("most")), "tree_id")
    code = F.concat("link", F.when(F.col("symbol") == "$", "Scene").otherwise(F.col("symbol")), F.when(F.col("index") == NO_INDEX, "").otherwise(F.col("index").cast("string")))
    place = F.concat(F.repeat(F.lit("\t"), F.col("lead")), F.when(F.col("_last") & F.col("parent_id").isNotNull(), "^").otherwise(""), code, F.repeat(F.lit("\t"), F.col("most") - F.col("lead")))
    shown = [F.coalesce(F.date_format(n, "d/M/yyyy") if t == "DD/MM/YY" else F.col(n).cast("string"), F.lit("")) for n, t in features]

    def part(df, section, seq, line):
        return df.select("tree_id", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), line.alias("line"))

    def texts(df, section, lines):
        return part(df.withColumn("_x", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(lines) - 1)).alias("i"), F.array(*map(F.lit, lines)).alias("l")))), section, F.col("_x.i"), F.col("_x.l"))

    trees = rows.where("parent_id is null").select("tree_id")
    if classes is None:
        classes = rows.groupBy("tree_id", "symbol", "scale").agg(F.min("tin").alias("seq")).select("tree_id", F.col("symbol").alias("SYMBOL"), F.col("scale").alias("SCALE"), F.lit("FREE").alias("DECOMPOSITION"), F.lit("FREE").alias("INDEXATION"), F.lit("IMPLICIT").alias("DEFINITION"), "seq")
    out = texts(trees, 0, ["CODE:\tFORM-A", ""])
    out = out.union(texts(trees, 1, ["CLASSES:", "\t".join(CLASSES)]))
    out = out.union(part(classes, 1, F.col("seq") + 2, F.concat_ws("\t", F.when(F.col("SYMBOL") == "Scene", "$").otherwise(F.col("SYMBOL")), F.col("SCALE").cast("string"), *[F.col(c) for c in CLASSES[2:]])))
    out = out.union(texts(trees, 2, ["", "DESCRIPTION:", "\t".join(DESCRIPTION)]))
    if description is not None:
        numbered = description.withColumn("_n", F.row_number().over(Window.partitionBy("tree_id").orderBy("LEFT", "RELTYPE")))
        out = out.union(part(numbered, 2, F.col("_n") + 3, F.concat_ws("\t", "LEFT", F.concat_ws(",", "RIGHT"), "RELTYPE", "MAX")))
    out = out.union(texts(trees, 3, ["", "FEATURES:", "\t".join(FEATURES), *[f"{n}\t{t}" for n, t in features], "", "MTG:"]))
    top = body.where("parent_id is null")
    out = out.union(part(top, 4, F.lit(0), F.concat_ws("\t", F.concat(F.lit("ENTITY-CODE"), F.repeat(F.lit("\t"), F.col("most"))), *[F.lit(n) for n, _ in features])))
    return out.union(part(body, 4, F.col("tin"), F.concat_ws("\t", place, *shown)))


def write_mtg(tree, path: str, **parts) -> list[str]:
    """Write one text file per tree, ``<tree>.mtg`` in a new folder (the name of a tree that ends in ``.mtg`` stays as it is; signs that a file's name can't
    hold are written as ``%`` and their code); returns the names. Raises an error, before anything is written, if two trees would share a file."""
    spark = tree.spark
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(top):
        raise FileExistsError(path)
    names = tree.nodes.where("parent_id is null").select("tree_id").distinct().withColumn("_file", file_name(F.col("tree_id")))
    if clash := names.groupBy("_file").agg(F.min("tree_id").alias("a"), F.max("tree_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").head():
        raise ValueError(f"the trees {clash.a} and {clash.b} would share the file {clash['_file']}")
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    lines = mtg_lines(tree, **parts).withColumn("_file", file_name(F.col("tree_id")))
    lines.repartition("_file").sortWithinPartitions("_file", "section", "seq").select("_file", F.col("line").alias("value")).write.partitionBy("_file").text(staging)
    return _moved(jvm, fs, jvm.org.apache.hadoop.fs.Path(staging), top)


def _moved(jvm, fs, staging, top) -> list[str]:
    """Moves the committed files ``_file=<name>/part-...`` to their names; only names pass through the driver. Nothing is deleted but what is empty."""
    from concurrent.futures import ThreadPoolExecutor
    from urllib.parse import unquote

    def move(folder) -> str:
        name = unquote(folder.getName().partition("=")[2])
        written = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        target = jvm.org.apache.hadoop.fs.Path(top, name)
        if len(written) != 1 or fs.exists(target) or not fs.rename(written[0], target):
            raise OSError(f"can't move {written} to {target}")
        if not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(folder)):
            fs.delete(folder, True)  # at most a checksum is left
        return name

    folders = [f.getPath() for f in fs.listStatus(staging) if f.isDirectory()]
    with ThreadPoolExecutor(8) as pool:
        names = sorted(pool.map(move, folders))
    if not any(f.isDirectory() for f in fs.listStatus(staging)):
        fs.delete(staging, True)
    return names
