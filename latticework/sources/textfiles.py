"""Plain text of single rows: sparse rows, small result steps as a stream gives them, mesh views, settings. Documents: see formats.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.strings import assignment

WHITE = r"\s+"


def parts(line) -> F.Column:
    return F.filter(F.split(F.trim(line), WHITE), lambda t: t != "")


def sparse_text(m: DataFrame, values: bool = True, numbering: int = 1) -> DataFrame:
    """(i, value): a line 'j v j v ...' for each row with entries; columns counted from numbering."""
    rows = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
    one = lambda e: F.concat_ws(" ", (e["j"] + numbering).cast("string"), e["v"].cast("string")) if values else (e["j"] + numbering).cast("string")
    return rows.select("i", F.concat_ws(" ", F.transform("r", one)).alias("value"))


def parse_sparse(lines: DataFrame, values: bool = True, numbering: int = 1) -> DataFrame:
    """(i, j, v) of lines (i, value); a value is 1 where the text has none."""
    t = lines.select("i", parts("value").alias("t"))
    if not values:
        return t.select("i", F.explode("t").alias("j")).select("i", (F.col("j").cast("long") - numbering).alias("j"), F.lit(1.0).alias("v"))
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: k % 2 == 0)
    e = t.filter("size(t) > 0").select("i", "t", F.explode(at).alias("k"))
    return e.select("i", (F.get("t", F.col("k")).cast("long") - numbering).alias("j"), F.get("t", F.col("k") + 1).cast("double").alias("v"))


STEP = r"(?s)Step\s+(\d+).*?Time\s*=\s*([-+.\deE]+)"


def parse_steps(texts: DataFrame) -> DataFrame:
    """(step, time, name, support, id, comp, value) of texts (value): steps, each with fields of a name, support and rows of data."""
    steps = texts.select(F.explode(F.split("value", "End Step")).alias("s")).filter(F.col("s").rlike(r"Step\s+\d+"))
    steps = steps.select(F.regexp_extract("s", STEP, 1).cast("int").alias("step"), F.regexp_extract("s", STEP, 2).cast("double").alias("time"), F.explode(F.slice(F.split("s", "Field"), 2, 1 << 30)).alias("f"))
    head = lambda key: F.regexp_extract("f", rf'{key}\s*=\s*"?([^"\n]+)"?', 1)
    data = F.split(F.trim(F.regexp_extract("f", r"(?s)Data\s*\n(.*)$", 1)), "\n")
    # The field's text must not stand beside its rows, where it would be copied and read again for each of them.
    fields = steps.select("step", "time", F.trim(head("Name")).alias("name"), F.trim(head("Support")).alias("support"), data.alias("data"))
    rows = fields.select("step", "time", "name", "support", F.posexplode("data").alias("id", "line"))
    return rows.select("step", "time", "name", "support", F.col("id").cast("long").alias("id"), F.posexplode(parts("line")).alias("comp", "v")).select("step", "time", "name", "support", "id", "comp", F.col("v").cast("double").alias("value"))


def steps_text(fields: DataFrame) -> DataFrame:
    """(step, value): the text of each step of (step, time, name, support, id, comp, value)."""
    rows = fields.groupBy("step", "time", "name", "support", "id").agg(F.sort_array(F.collect_list(F.struct("comp", "value"))).alias("c"))
    rows = rows.select("step", "time", "name", "support", "id", F.concat_ws(" ", F.transform("c", lambda c: c["value"].cast("string"))).alias("line"))
    one = rows.groupBy("step", "time", "name", "support").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("r"))
    text = F.concat(F.lit("Field\nName = \""), F.col("name"), F.lit("\"\nSupport = \""), F.col("support"), F.lit("\"\nData\n"), F.concat_ws("\n", F.transform("r", lambda r: r["line"])))
    steps = one.select("step", "time", "name", text.alias("f")).groupBy("step", "time").agg(F.sort_array(F.collect_list(F.struct("name", "f"))).alias("fs"))
    return steps.select("step", F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit("\nTime = "), F.col("time").cast("string"), F.lit("\n"), F.concat_ws("\n", F.transform("fs", lambda f: f["f"])), F.lit("\nEnd Step\n")).alias("value"))


def vtk_cells(elem: DataFrame) -> DataFrame:
    """(elem, line, type): the cell line of each element (elem, pos, nid) and its type, 5 of three nodes, 9 of four, else 7."""
    rows = elem.groupBy("elem").agg(F.sort_array(F.collect_list(F.struct("pos", "nid"))).alias("r"))
    line = F.concat_ws(" ", F.size("r").cast("string"), F.transform("r", lambda r: r["nid"].cast("string")))
    return rows.select("elem", line.alias("line"), F.when(F.size("r") == 3, 5).when(F.size("r") == 4, 9).otherwise(7).alias("type"))


def settings(lines: DataFrame) -> DataFrame:
    """(name, value, number) of lines (line); number is null where the value is none."""
    a = lines.select(assignment(F.col("line")).alias("a")).filter("a is not null")
    return a.select("a.name", "a.value", F.expr("try_cast(a.value as double)").alias("number"))
