"""Lines of files in any encoding, cut anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from plateauscope.sources import ingest as G

MARK = {"utf-8": b"", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}


def lines_of(rng, n):
    letters = "aZ;,\t" + "ਅĀĊЊਊ上਀\u000d" + "é日🙂"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(n)]


@pytest.mark.parametrize("split", ["128m", "400"])
def test_lines_of_every_encoding(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for k in range(4):
        for name, mark in MARK.items():
            lines = lines_of(rng, 40) + (["end"] if k % 2 else [])
            end = "\n" if k != 1 else ""
            (tmp_path / f"{name}{k}.csv").write_bytes(mark + ("\n".join(lines) + end).encode(name))
            text = "\n".join(lines) + end
            out = text.split("\n")
            if out[-1] == "":
                out.pop()
            want[f"{name}{k}.csv"] = out
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in G.read_lines(spark, str(tmp_path)).orderBy("file", "line_no").collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.value))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in want.items():
        assert [v for _, v in got[name]] == lines, name
        assert [n for n, _ in got[name]] == list(range(len(lines)))


def test_spreadsheets_and_tables_in_utf16(spark, tmp_path):
    table = 'Pass;Profit;Name\n1;1.234,50;"é;1"\n2;-0,25;"ਅ"\n'
    sheet = ('<?xml version="1.0"?><Workbook><Worksheet><Table><Row><Cell><Data ss:Type="String">Pass</Data></Cell>'
             '<Cell><Data ss:Type="String">Profit</Data></Cell><Cell><Data ss:Type="String">Name</Data></Cell></Row>\n'
             '<Row><Cell><Data ss:Type="Number">1</Data></Cell><Cell><Data ss:Type="Number">2.5</Data></Cell>'
             '<Cell><Data ss:Type="String">é &amp; Ċ</Data></Cell></Row></Table></Worksheet></Workbook>')
    for name, mark in MARK.items():
        (tmp_path / f"{name}.csv").write_bytes(mark + table.encode(name))
        (tmp_path / f"{name}.xml").write_bytes(mark + sheet.encode(name))
    cells = G.finish_table(G.read_delimited(spark, str(tmp_path / "*.csv")))
    got = {}
    for r in cells.withColumn("f", F.element_at(F.split("file", "/"), -1)).collect():
        got.setdefault((r.f, r.header), []).append(r.num if r.header == "Profit" else r.text)
    for name in MARK:
        assert sorted(got[f"{name}.csv", "Profit"]) == [-0.25, 1234.5]
        assert sorted(got[f"{name}.csv", "Name"]) == ["é;1", "ਅ"]
    rows = G.finish_table(G.read_spreadsheet_xml(spark, str(tmp_path / "*.xml"))).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.header, r.text) for r in rows) == sorted(
        (f"{n}.xml", h, t) for n in MARK for h, t in (("Pass", "1"), ("Profit", "2.5"), ("Name", "é & Ċ")))


def test_no_files_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe")
    assert G.read_lines(spark, str(tmp_path)).count() == 0


def test_report_cells_stay_in_their_row(spark):
    """Labels are paired inside a row: the cells of the deals are never moved."""
    html = ("<table><tr><td>Symbol:</td><td></td><td><b>EUR&amp;USD</b></td><td>Total Trades:</td><td>2</td></tr>"
            "<tr><td>Symbol:</td><td>late</td></tr><tr><td>Profit Factor:</td></tr>"
            "<tr><td>Inputs:</td><td>a=1</td></tr><tr><td></td><td>b=2</td></tr><tr><td> </td><td>x</td></tr>"
            "<tr><td>Deals</td><td>c=3</td></tr><tr><td></td><td>d=4</td></tr></table>")
    rows = G.report_rows(spark.createDataFrame([(1, html)], "report_id int, html string"))
    figures = G.report_figures(rows)
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "row_no" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)
    r = figures.collect()[0]
    assert (r.symbol, r.trades, r.profit_factor) == ("EUR&USD", 2.0, None)
    assert {(x.name, x.text) for x in G.report_inputs(rows).collect()} == {("a", "1"), ("b", "2")}
