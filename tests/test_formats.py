"""Text formats by lines: headers, flags, comments, faults, documents of several files."""

from latticework.sources import formats as FM
from latticework.sources import lines as L


def written(tmp_path, **files):
    for name, text in files.items():
        f = tmp_path / name.replace("__", "/")
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_graph_with_flags(spark, tmp_path):
    # Vertex sizes, two weights, edge weights; a row without edges, comments between rows.
    text = "% a graph\n4 3 111 2\n5 1 2 2 7 3 8\n% again\n6 1 2 1 7 3 9\n7 0 0 1 8 2 9\n8 3 4\n"
    entries, rows, faults = FM.matrix_read(L.lines_of(spark, written(tmp_path, g=text)), "graph")
    assert sorted((r.i, r.j, r.v) for r in entries.collect()) == [(0, 1, 7.0), (0, 2, 8.0), (1, 0, 7.0), (1, 2, 9.0), (2, 0, 8.0), (2, 1, 9.0)]
    assert sorted((r.i, r["size"], r.weights) for r in rows.collect()) == [(0, 5.0, [1.0, 2.0]), (1, 6.0, [1.0, 2.0]), (2, 7.0, [0.0, 0.0]), (3, 8.0, [3.0, 4.0])]
    assert faults.isEmpty()


def test_each_document_has_its_own_header(spark, tmp_path):
    entries, _, faults = FM.matrix_read(L.lines_of(spark, written(tmp_path, a="2 1\n2\n1\n", b="2 1 1\n2 5\n1 5\n", c="3 1 10\n4 2\n4 1\n", d="2 2\n2 0\n1\n")), "graph")
    name = lambda r: r.doc[-1]
    assert sorted((name(r), r.i, r.j, r.v) for r in entries.filter("doc not like '%/d'").collect()) == [("a", 0, 1, 1.0), ("a", 1, 0, 1.0), ("b", 0, 1, 5.0), ("b", 1, 0, 5.0), ("c", 0, 1, 1.0), ("c", 1, 0, 1.0)]
    assert sorted((name(r), r.fault, r.expected, r.found) for r in faults.collect()) == [("c", "rows", 3, 2), ("d", "columns", 0, 1), ("d", "entries", 4, 3)]


def test_sized_and_plain_rows(spark, tmp_path):
    folder = written(tmp_path, m="2 9 3\n1 0.5 3 1.5\n9 2\n")
    entries, _, faults = FM.matrix_read(L.lines_of(spark, folder), "sized")
    assert sorted((r.i, r.j, r.v) for r in entries.collect()) == [(0, 0, 0.5), (0, 2, 1.5), (1, 8, 2.0)] and faults.isEmpty()
    plain, _, faults = FM.matrix_read(L.lines_of(spark, folder), "plain", values=True, numbering=0)
    assert (0, 2, 3) not in {(r.i, r.j, r.v) for r in plain.collect()} and [(r.fault, r.found) for r in faults.collect()] == [("values", 1)]
    bare, _, _ = FM.matrix_read(L.lines_of(spark, written(tmp_path / "x", m="0 4\n\n2\n") if (tmp_path / "x").mkdir() is None else ""), "plain", values=False, numbering=0)
    assert sorted((r.i, r.j, r.v) for r in bare.collect()) == [(0, 0, 1.0), (0, 4, 1.0), (2, 2, 1.0)]


def test_planar_graph_with_numbers_anywhere(spark, tmp_path):
    text = "# a square\n4 0 0\n1 0 1 1 0 1\n4\n0 1 1 2 2\n3 3 0\n1 0.5\n0.25 # seed\n"
    t = FM.pslg_read(L.lines_of(spark, written(tmp_path, p=text, q="1\n2 3\n0\n0\n"), comment="#.*$"))
    at = lambda r: r.doc[-1]
    assert sorted((at(r), r.vid, r.x, r.y) for r in t["vertex"].collect()) == [("p", 0, 0, 0), ("p", 1, 1, 0), ("p", 2, 1, 1), ("p", 3, 0, 1), ("q", 0, 2, 3)]
    assert sorted((r.eid, r.v1, r.v2) for r in t["edge"].collect()) == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0)]
    assert [(r.hid, r.x, r.y) for r in t["hole"].collect()] == [(0, 0.5, 0.25)]


STEPS = '''Step 1
Time = 0.5
Field
Type = Vector
Name = "disp"
Support = Nodes
Data
1 2
3 4
End Data
End Field
Field
Type = SymTensor
Name = "stress"
Support = Elements
Data
1 2 3 99
End Data
End Field
End Step
Step 2   # later
Time = 1
Field
Type = Scalar
Name = "damage"
Support = Elements
'''
MORE = "Data\n7\n8\nEnd Data\nEnd Field\nEnd Step\nStep 3\nTime = 2\nEnd Step\n"


def test_steps_over_several_files(spark, tmp_path):
    folder = written(tmp_path, doc__part_0=STEPS, doc__part_1=MORE)
    lines = L.lines_of(spark, f"{folder}/doc", folders=True, comment="#.*$")
    found = sorted((r.step, r.time, r.name, r.type, r.support, r.id, r.comp, r.value) for r in FM.steps_read(lines).collect())
    assert found == [
        (1, 0.5, "disp", "Vector", "Nodes", 0, 0, 1.0), (1, 0.5, "disp", "Vector", "Nodes", 0, 1, 2.0), (1, 0.5, "disp", "Vector", "Nodes", 1, 0, 3.0), (1, 0.5, "disp", "Vector", "Nodes", 1, 1, 4.0),
        (1, 0.5, "stress", "SymTensor", "Elements", 0, 0, 1.0), (1, 0.5, "stress", "SymTensor", "Elements", 0, 1, 2.0), (1, 0.5, "stress", "SymTensor", "Elements", 0, 2, 3.0),
        (2, 1.0, "damage", "Scalar", "Elements", 0, 0, 7.0), (2, 1.0, "damage", "Scalar", "Elements", 1, 0, 8.0),
    ]
    assert FM.steps_read(lines, name="disp", step=2).isEmpty() and FM.steps_read(lines, step=2).count() == 2
    assert sorted((r.step, r.time) for r in FM.step_list(lines).collect()) == [(1, 0.5), (2, 1.0), (3, 2.0)]


def test_numbers_and_marks_over_many_blocks(spark, tmp_path):
    """Blocks of a few lines each, as of a very large file."""
    folder = written(tmp_path, f="".join(f"{k} {'*' if k % 37 == 0 else '-'}\n" for k in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        lines = L.lines_of(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines.select("block").distinct().count() > 10
    from pyspark.sql import functions as F

    k = F.split("line", " ")[0].cast("long")
    rows = L.carried(L.numbered(lines), {"star": F.when(F.col("line").endswith("*"), k)}).select("n", k.alias("k"), "star").collect()
    assert len(rows) == 2000 and all(r.n == r.k and r.star == r.k // 37 * 37 for r in rows)
