"""Text formats line by line: points, planar graphs, sparse matrices and graphs with headers and flags, timed result fields.

Readers take lines (see lines.py) and give tables; writers give lines with their order. A document may hold any part of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.lines import carried, numbered, told
from latticework.sources.scratch import stored

#: Components of a field's type (fixed names of the format).
COMPONENTS = {"Scalar": 1, "Vector": 2, "SymTensor": 3, "Tensor": 4}
SUPPORTS = ("Nodes", "Edges", "Elements")
#: Entries of a task that gathers rows of a matrix or corners of cells.
TASK_ROWS = 400_000


def tokens(line: str | Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


# Points: a count, then a line 'x y' for each.


def point_lines(points: DataFrame) -> DataFrame:
    """(key, pid, line) of points (key, pid, x, y); the count stands before them, with pid null."""
    count = points.groupBy("key").agg(F.count("*").cast("string").alias("line")).select("key", F.lit(None).cast("long").alias("pid"), "line")
    return count.unionByName(points.select("key", F.col("pid").cast("long").alias("pid"), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("line")))


def points_read(lines: DataFrame) -> DataFrame:
    """(doc, pid, x, y), pid by order; lines after the counted ones are left out."""
    rows = told(numbered(lines), {"count": F.when(F.col("n") == 0, tokens("line")[0].cast("long"))})
    t = tokens("line")
    return rows.filter((F.col("n") > 0) & (F.col("n") <= F.col("count"))).select("doc", (F.col("n") - 1).alias("pid"), F.get(t, F.lit(0)).cast("double").alias("x"), F.get(t, F.lit(1)).cast("double").alias("y"))


# Planar graphs: N, vertices, M, edges, H, holes, as numbers between white space.


def pslg_lines(vertex: DataFrame, edge: DataFrame, hole: DataFrame) -> DataFrame:
    """(key, part, id, line) of vertex (model, vid, x, y), edge (model, eid, v1, v2), hole (model, hid, x, y); counts have a null id."""
    models = vertex.select("model").unionByName(edge.select("model")).unionByName(hole.select("model")).distinct()
    out = []
    for part, (rows, key, a, b) in enumerate(((vertex, "vid", "x", "y"), (edge, "eid", "v1", "v2"), (hole, "hid", "x", "y"))):
        counts = models.join(rows.groupBy("model").agg(F.count("*").alias("c")), "model", "left").select("model", F.lit(None).cast("long").alias("id"), F.coalesce("c", F.lit(0)).cast("string").alias("line"))
        each = rows.select("model", F.col(key).cast("long").alias("id"), F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("line"))
        out.append(counts.unionByName(each).select(F.col("model").alias("key"), F.lit(part).alias("part"), "id", "line"))
    return reduce(DataFrame.unionByName, out)


def pslg_read(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables vertex (doc, vid, x, y), edge (doc, eid, v1, v2) and hole (doc, hid, x, y); a line may hold any numbers of a document's."""
    now = numbered(lines, "first", F.size(tokens("line"))).withColumn("t", tokens("line"))
    here = lambda place: (F.col("first") <= place) & (place < F.col("first") + F.size("t"))
    m_at, h_at = 1 + 2 * F.col("n"), 2 + 2 * F.col("n") + 2 * F.col("m")
    # Each count says where the next one stands; a row for each document knows them.
    counts = None
    for name, place in (("n", F.lit(0)), ("m", m_at), ("h", h_at)):
        said = (now if counts is None else now.join(counts, "doc")).filter(here(place)).select("doc", F.get("t", (place - F.col("first")).cast("int")).cast("long").alias(name))
        counts = stored(said if counts is None else counts.join(said, "doc", "left"), "counts")
    each = now.join(counts, "doc").select("doc", "n", "m", "h", "first", F.posexplode("t").alias("k", "token")).withColumn("k", F.col("first") + F.col("k"))

    def pairs(begin: Column, count: Column, names: tuple[str, str, str], kind: str) -> DataFrame:
        rows = each.filter((F.col("k") >= begin) & (F.col("k") < begin + 2 * count)).withColumn("k", F.col("k") - begin)
        side = lambda s, name: F.max(F.when(F.col("k") % 2 == s, F.col("token").cast(kind))).alias(name)
        return rows.groupBy("doc", F.floor(F.col("k") / 2).alias(names[0])).agg(side(0, names[1]), side(1, names[2]))

    return {"vertex": pairs(F.lit(1), F.col("n"), ("vid", "x", "y"), "double"), "edge": pairs(m_at + 1, F.col("m"), ("eid", "v1", "v2"), "long"), "hole": pairs(h_at + 1, F.col("h"), ("hid", "x", "y"), "double")}


# Sparse matrices and graphs: a line for each row; lines of % are none.


def matrix_lines(entries: DataFrame, rows: DataFrame, form: str, columns: int | None = None, values: bool = True, numbering: int = 1, sizes: str | None = None, weights: list[str] = ()) -> DataFrame:
    """(i, line): entries (i, j, v) as lines, one for each of rows (i, ...), which are numbered from 0 without gaps; a header has i = -1.

    form is plain (no header; values and numbering as given), sized ('rows columns entries', values, counted from 1) or graph ('vertices edges' and, where there
    are any, flags for sizes, weights and values; entries both ways, counted from 1). sizes and weights name columns of rows.
    """
    if form != "plain":
        numbering = 1
    values = values or form == "sized"
    one = lambda e: F.concat_ws(" ", (e["j"] + numbering).cast("string"), *([e["v"].cast("string")] if values else []))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // TASK_ROWS))
    lists = entries.repartition(tasks, "i").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    ahead = [F.col(c).cast("string") for c in ([sizes] if sizes else []) + list(weights)]
    body = rows.repartition(tasks, "i").join(lists, "i", "left").select(F.col("i").cast("long").alias("i"), F.concat_ws(" ", *ahead, F.transform(F.coalesce("e", F.array()), one)).alias("line"))
    if form == "plain":
        return body
    counts = rows.agg(F.count("*").alias("n")).join(entries.agg(F.count("*").alias("m"), (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("c")), F.lit(True))
    if form == "sized":
        head = [F.col("n"), F.lit(columns) if columns is not None else F.col("c"), F.col("m")]
    else:
        head = [F.col("n"), F.expr("m div 2")]
        if sizes or weights or values:
            head.append(F.lit(f"{int(bool(sizes))}{int(bool(weights))}{int(values)}"))
            if len(weights) > 1:
                head.append(F.lit(len(weights)))
    return counts.select(F.lit(-1).cast("long").alias("i"), F.concat_ws(" ", *[h.cast("string") for h in head]).alias("line")).unionByName(body)


def matrix_read(lines: DataFrame, form: str, values: bool = True, numbering: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries (doc, i, j, v), rows (doc, i, size, weights), faults (doc, fault, expected, found)) of lines in a form of matrix_lines.

    Each document's own header says how its lines are laid out. A value is 1 where the text has none. faults lists documents with
    fewer rows or other entries than the header says, an entry without its value, or a column below the first.
    """
    row = ~F.col("line").startswith("%")
    now = numbered(lines, weight=row.cast("int")).filter(row)
    t = tokens("line")
    whole = lambda k: F.get(t, F.lit(k)).cast("long")
    if form == "plain":
        now = now.withColumns({"i": F.col("n"), "skip": F.lit(0), "sized": F.lit(False), "held": F.lit(values), "says_rows": F.lit(None).cast("long"), "says_entries": F.lit(None).cast("long")})
    else:
        numbering = 1
        flags = F.lpad(F.coalesce(F.get(t, F.lit(2)), F.lit("0")), 3, "0")
        own = F.lit("001") if form == "sized" else flags
        more = F.lit(1) if form == "sized" else F.greatest(F.coalesce(whole(3), F.lit(1)), F.lit(1))
        head = F.struct(whole(0).alias("rows"), (whole(2) if form == "sized" else 2 * whole(1)).alias("entries"), own.alias("flags"), more.alias("more"))
        now = told(now, {"head": F.when(F.col("n") == 0, head)}).filter("n > 0")
        flag = lambda k: F.substring("head.flags", k, 1) == "1"
        skip = F.when(flag(1), 1).otherwise(0) + F.when(flag(2), F.col("head.more")).otherwise(0)
        now = now.withColumns({"i": F.col("n") - 1, "skip": skip.cast("int"), "sized": flag(1), "held": flag(3), "says_rows": F.col("head.rows"), "says_entries": F.col("head.entries")})
        now = now.filter("i < says_rows")
    now = now.withColumn("t", t)
    ahead = F.when(F.col("sized"), 1).otherwise(0)
    rows = now.select("doc", "i", F.when(F.col("sized"), F.get("t", F.lit(0)).cast("double")).alias("size"), F.slice("t", ahead + 1, F.col("skip") - ahead).cast("array<double>").alias("weights"))
    each = now.select("doc", "i", "held", F.slice("t", F.col("skip") + 1, F.greatest(F.size("t") - F.col("skip"), F.lit(0))).alias("t"))
    step = F.when(F.col("held"), 2).otherwise(1)
    each = each.filter(F.size("t") > 0).select("doc", "i", "held", "t", F.explode(F.sequence(F.lit(0), (F.size("t") - 1), step)).alias("k"))
    entries = each.select("doc", "i", (F.get("t", F.col("k")).cast("long") - numbering).alias("j"), F.when(F.col("held"), F.get("t", F.col("k") + 1).cast("double")).otherwise(1.0).alias("v"))
    kept = entries.groupBy("doc").agg(F.count("*").alias("found"), F.count(F.when(F.col("v").isNull(), 1)).alias("bare"), F.count(F.when(F.col("j").isNull() | (F.col("j") < 0), 1)).alias("low"))
    says = now.groupBy("doc").agg(F.count("*").alias("n"), F.max("says_rows").alias("rows"), F.max("says_entries").alias("entries"))
    sums = says.join(kept, "doc", "left").select("doc", "n", "rows", "entries", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "bare", "low")])
    fault = lambda name, a, b: F.struct(F.lit(name).alias("fault"), F.col(a).cast("long").alias("expected") if a else F.lit(0).cast("long").alias("expected"), F.col(b).cast("long").alias("found"))
    faults = sums.select("doc", F.explode(F.array(fault("rows", "rows", "n"), fault("entries", "entries", "found"), fault("values", None, "bare"), fault("columns", None, "low"))).alias("f"))
    # Stored, its size is known: documents with faults are few, and a join with them must not gather all entries of a document in one task.
    return entries, rows, stored(faults.select("doc", "f.*").filter("expected <> found"), "faults")


# Meshes: sections of points, cells and cell types, each with its counts.

#: Types of cells by their number of corners, the last for all others (fixed values of the format).
CELL_TYPES = {3: 5, 4: 9, None: 7}


def mesh_lines(node: DataFrame, elem: DataFrame, title: str = "mesh") -> DataFrame:
    """(part, row, line) of node (nid, x, y) and elem (elem, pos, nid); nodes and elements are numbered in order of their ids."""
    from latticework.operators.graph import ranked

    n = ranked(node.select("nid", "x", "y"), [F.col("nid")])
    tasks = max(int(elem.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-elem.count() // TASK_ROWS))
    cells = elem.repartition(tasks, "nid").join(n.select("nid", F.col("rank").alias("i")), "nid").repartition(tasks, "elem").groupBy("elem").agg(F.sort_array(F.collect_list(F.struct("pos", "i"))).alias("c"))
    cells = ranked(cells, [F.col("elem")]).withColumn("k", F.size("c"))
    kind = F.when(F.col("k") == 3, CELL_TYPES[3]).when(F.col("k") == 4, CELL_TYPES[4]).otherwise(CELL_TYPES[None])
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    row = lambda part, at, line: [F.lit(part).alias("part"), at.cast("long").alias("row"), line.alias("line")]
    first = F.lit(-1)
    counts = cells.agg(F.count("*").alias("m"), F.coalesce(F.sum("k"), F.lit(0)).alias("all"))
    parts = [
        n.agg(F.concat(F.lit(f"# vtk DataFile Version 2.0\n{title}\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS "), F.count("*").cast("string"), F.lit(" double")).alias("head")).select(*row(0, first, F.col("head"))),
        n.select(*row(0, F.col("rank"), text(F.col("x"), F.col("y"), F.lit(0)))), counts.select(*row(1, first, text(F.lit("CELLS"), F.col("m"), F.col("m") + F.col("all")))),
        cells.select(*row(1, F.col("rank"), F.concat_ws(" ", F.col("k").cast("string"), F.transform("c", lambda c: c["i"].cast("string"))))),
        counts.select(*row(2, first, text(F.lit("CELL_TYPES"), F.col("m")))), cells.select(*row(2, F.col("rank"), kind.cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def mesh_read(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables node (doc, i, x, y), elem (doc, elem, pos, i) and type (doc, elem, type) of documents with a point, cell or type on each line."""
    now = numbered(lines)
    head = F.regexp_extract("line", r"^\s*(POINTS|CELLS|CELL_TYPES)\s", 1)
    # A section goes on for as many lines as it counts, or to the next one; a row for each section says so.
    said = now.filter(head != "").select("doc", head.alias("section"), F.col("n").alias("begin"), tokens("line")[1].cast("long").alias("count"))
    sections = stored(said.withColumn("next", F.lead("begin").over(W.partitionBy("doc").orderBy("begin"))), "sections")
    row = F.col("n") - F.col("begin") - 1
    inside = (row >= 0) & (row < F.col("count")) & (F.col("next").isNull() | (F.col("n") < F.col("next")))
    rows = now.join(sections, "doc").filter(inside).select("doc", "section", row.alias("k"), tokens("line").alias("t"))
    of = lambda section: rows.filter(F.col("section") == section)
    whole = lambda k: F.get("t", F.lit(k))
    corners = of("CELLS").select("doc", F.col("k").alias("elem"), F.posexplode(F.slice("t", 2, F.size("t"))).alias("pos", "i"))
    return {
        "node": of("POINTS").select("doc", F.col("k").alias("i"), whole(0).cast("double").alias("x"), whole(1).cast("double").alias("y")),
        "elem": corners.withColumn("i", F.col("i").cast("long")), "type": of("CELL_TYPES").select("doc", F.col("k").alias("elem"), whole(0).cast("int").alias("type")),
    }


# Timed result fields: steps of fields of rows.


def step_lines(fields: DataFrame) -> DataFrame:
    """(key, step, part, name, row, line) of fields (key, step, time, name, support, id, comp, value); a row of a field for each id, in their order.

    A field's type is that of its number of components. The order of the lines is that of the columns before line.
    """
    types = F.create_map(*[F.lit(x) for name, k in COMPONENTS.items() for x in (k, name)])
    order = lambda part, name, row: [F.lit(part).alias("part"), name.alias("name"), row.cast("long").alias("row")]
    last = F.lit((1 << 63) - 1)
    rows = fields.groupBy("key", "step", "name", "id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("comp", "value"))), lambda c: c["value"].cast("string"))).alias("line"))
    heads = fields.groupBy("key", "step", "name").agg(F.first("support").alias("support"), (F.max("comp") + 1).cast("int").alias("k"))
    open_ = F.concat(F.lit("Field\nType = "), types[F.col("k")], F.lit('\nName = "'), F.col("name"), F.lit('"\nSupport = '), F.col("support"), F.lit("\nData"))
    steps = fields.groupBy("key", "step").agg(F.first("time").alias("time"))
    begin = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit("\nTime = "), F.col("time").cast("string"))
    parts = [
        steps.select("key", "step", *order(0, F.lit(""), F.lit(0)), begin.alias("line")), heads.select("key", "step", *order(1, F.col("name"), F.lit(-1)), open_.alias("line")),
        rows.select("key", "step", *order(1, F.col("name"), F.col("id")), "line"), heads.select("key", "step", *order(1, F.col("name"), last), F.lit("End Data\nEnd Field").alias("line")),
        steps.select("key", "step", *order(2, F.lit(""), F.lit(0)), F.lit("End Step").alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _said(name: str) -> Column:
    """What a line 'name = value' says, without quotes."""
    found = F.regexp_extract("line", rf'^\s*{name}\s*=\s*"?([^"]*?)"?\s*$', 1)
    return F.when(found != "", found)


def _step_number() -> Column:
    return F.when(F.col("line").rlike(r"^\s*Step\s+\d+\s*$"), F.regexp_extract("line", r"(\d+)", 1).cast("int"))


def step_list(lines: DataFrame) -> DataFrame:
    """(doc, step, time) of the steps of documents, without their rows."""
    heads = lines.filter(F.col("line").rlike(r"^\s*(Step\s+\d+|Time\s*=.*)\s*$"))
    return carried(heads, {"step": _step_number()}).withColumn("time", _said("Time").cast("double")).filter("time is not null").select("doc", "step", "time")


def steps_read(lines: DataFrame, name: str | None = None, step: int | None = None) -> DataFrame:
    """(doc, step, time, name, type, support, id, comp, value), ids by order from 0; of one name or step only where they are given.

    A row has as many components as its field's type says; what stands behind them is left out, what lacks is null. Fields of an unknown type or support are left out.
    """
    word = F.trim("line")
    now = numbered(lines, weight=(word != "").cast("int")).filter(word != "")
    now = carried(now, {"step": _step_number(), "time": _said("Time").cast("double"), "type": _said("Type"), "name": _said("Name"), "support": _said("Support"), "data": F.when(word == "Data", F.col("n")).when(word == "End Data", F.lit(-1))})
    rows = now.filter((F.col("data") >= 0) & (F.col("n") > F.col("data")))
    for column, asked in (("name", name), ("step", step)):
        if asked is not None:
            rows = rows.filter(F.col(column) == asked)
    size = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), COMPONENTS.items(), F.when(F.lit(False), 0))
    rows = rows.withColumn("size", size).filter(F.col("size").isNotNull() & F.col("support").isin(*SUPPORTS)).withColumn("t", tokens("line"))
    each = rows.select("doc", "step", "time", "name", "type", "support", (F.col("n") - F.col("data") - 1).alias("id"), "t", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("comp"))
    return each.select("doc", "step", "time", "name", "type", "support", "id", "comp", F.get("t", F.col("comp")).cast("double").alias("value"))
