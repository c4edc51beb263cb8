"""Workbooks made by hand, and caches whose writers fail."""

import datetime
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from origo import sources
from origo.sources import sheets

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, tables, *, shared=(), late=False, formats=""):
    """A workbook of `{sheet: xml of its rows}`. Styles: 0 plain, 1 a date, 2 own
    format 164, 3 own format 165."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS}><workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{k}" Type="t" Target="{"/xl/" if k == 2 else ""}worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet {NS}><numFmts>{formats}</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        for k, rows in enumerate(tables.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"{HEAD}<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def row(number, *cells):
    """(reference, type, style, value) each; a value of None leaves an empty cell."""
    inner = "".join(f'<c r="{ref}{number}" t="{kind}" s="{style}">' + ("" if v is None else f"<is><t>{v}</t></is>" if kind == "inlineStr" else f"<v>{v}</v>") + "</c>" for ref, kind, style, v in cells)
    return f'<row r="{number}">{inner}</row>'


SCHEMA = "name string, n int, price double, at timestamp_ntz, ok boolean, cost decimal(8,2), day date"
HEADER = row(1, *[(c, "inlineStr", 0, n) for c, n in zip("ABCDEFH", ["name", "n", "price", "at", "ok", "cost", "day"])])


def test_cells(spark, tmp_path):
    shared = ["<t>plain</t>", "<r><t>rich </t></r><r><t>é &amp; more</t></r><rPh><t>hint</t></rPh>"]
    one = HEADER + row(2, ("A", "s", 0, 0), ("B", "n", 0, 3), ("C", "n", 0, 1.5), ("D", "n", 1, 40544.5), ("E", "b", 0, 1), ("F", "n", 0, 2.345), ("H", "n", 1, 40544))
    one += row(4, ("A", "s", 0, 1), ("C", "n", 0, "1E3"), ("D", "d", 0, "2011-02-03T04:05:06"), ("E", "e", 0, "#N/A"), ("G", "n", 0, 9)) + row(5, ("A", "n", 0, None)) + "<row/>"
    two = HEADER + row(2, ("A", "n", 0, 489434), ("B", "str", 0, 7), ("D", "n", 2, 40544.25), ("E", "b", 0, 0)) + row(3, ("A", "n", 0, 1.25), ("D", "n", 3, 59))
    formats = '<numFmt numFmtId="164" formatCode="&quot;at&quot; hh:mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/>'
    path = workbook(tmp_path / "a.xlsx", {"one": one, "two & more": two}, shared=shared, formats=formats)
    df = sources.read_sheets(spark, [path], SCHEMA)
    assert df.rdd.getNumPartitions() == 2
    at = datetime.datetime
    want = [
        ("plain", 3, 1.5, at(2011, 1, 1, 12), True, "2.34", datetime.date(2011, 1, 1)), ("rich é & more", None, 1000.0, at(2011, 2, 3, 4, 5, 6), None, None, None),
        ("489434", 7, None, at(2011, 1, 1, 6), False, None, None), ("1.25", None, None, at(1900, 2, 28), None, None, None),
    ]
    got = [tuple(str(v) if c == "cost" and v is not None else v for c, v in zip(df.columns, r)) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sources.read_sheets(spark, [path], "price double, name string", ["two & more"]).select("name").orderBy("name").collect() == [("1.25",), ("489434",)]
    assert df.filter("n = 3").select("name").first()["name"] == "plain"


def test_retail_from_two_sheets(spark, tmp_path):
    names = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
    head = row(1, *[(c, "inlineStr", 0, n) for c, n in zip("ABCDEFGH", names)])
    line = lambda k, inv, q: row(k, ("A", "n" if isinstance(inv, int) else "inlineStr", 0, inv), ("B", "inlineStr", 0, "85048"), ("D", "n", 0, q), ("E", "n", 1, 40148.32), ("F", "n", 0, 2.5), ("G", "n", 0, 13085), ("H", "inlineStr", 0, "UK"))
    path = workbook(tmp_path / "r.xlsx", {"2009": head + line(2, 489434, 2) + line(3, "C489435", 4), "2010": head + line(2, 536365, 6)})
    found = sources.load_retail(spark, path, str(tmp_path / "cache"))
    assert sorted((r["invoice"], r["quantity"], r["revenue"], r["customer_id"]) for r in found.collect()) == [("489434", 2, 5.0, 13085), ("536365", 6, 15.0, 13085)]


def test_other_dates_and_faults(spark, tmp_path):
    late = workbook(tmp_path / "l.xlsx", {"s": row(1, ("A", "inlineStr", 0, "d")) + row(2, ("A", "n", 1, 1))}, late=True)
    assert sources.read_sheets(spark, [late], "d date").first()["d"] == datetime.date(1904, 1, 2)
    empty = workbook(tmp_path / "e.xlsx", {"s": "", "t": row(1, ("A", "inlineStr", 0, "d"))})
    assert sources.read_sheets(spark, [empty], "d date").count() == 0
    wrong = workbook(tmp_path / "w.xlsx", {"s": row(1, ("A", "inlineStr", 0, "n")) + row(7, ("A", "inlineStr", 0, "many"))})
    with pytest.raises(Exception, match="sheet s, row 7"):
        sources.read_sheets(spark, [wrong], "n int").collect()
    with pytest.raises(Exception, match="no column m"):
        sources.read_sheets(spark, [wrong], "n string, m int").collect()
    with pytest.raises(Exception, match="no sheet u"):
        sources.read_sheets(spark, [wrong], "n string", ["u"]).collect()
    with pytest.raises(ValueError):
        sheets.converted(2.5, sheets.T.IntegerType())


def test_many_rows_are_a_stream(spark, tmp_path):
    rows = row(1, ("A", "inlineStr", 0, "n")) + "".join(f"<row><c><v>{k}</v></c></row>" for k in range(20_000))
    path = workbook(tmp_path / "m.xlsx", {"s": rows})
    assert sources.read_sheets(spark, [path], "n long").agg(F.count("n"), F.sum("n")).first() == (20_000, 199_990_000)


def test_cache_is_read_whole_or_not_at_all(spark, tmp_path):
    """A writer that fails half-way leaves nothing that is read."""
    cache, raw = str(tmp_path / "cache"), tmp_path / "raw"
    raw.mkdir()
    good = spark.range(100).repartition(4)
    bad = good.select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("stopped"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        sources.read_through(spark, cache, str(raw), lambda: bad)
    assert sources.committed(spark, cache) is None
    # What a killed job leaves: some part files, and no mark.
    good.limit(26).write.mode("overwrite").parquet(f"{cache}/table-000000000")
    assert sources.read_through(spark, cache, str(raw), lambda: good).count() == 100
    held = sources.read_through(spark, cache, str(raw), lambda: bad)
    assert held.count() == 100
    with pytest.raises(Exception, match="stopped"):
        sources.read_through(spark, cache, str(raw), lambda: bad, force_reload=True)
    assert sources.read_through(spark, cache, str(raw), lambda: bad).count() == 100
    more = sources.read_through(spark, cache, str(raw), lambda: spark.range(7), force_reload=True)
    assert more.count() == 7 and held.count() == 100
    sources.read_through(spark, cache, str(raw), lambda: spark.range(8), force_reload=True)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")) == ["_mark-table-000000001", "_mark-table-000000002", "table-000000001", "table-000000002"]
    with pytest.raises(FileNotFoundError):
        sources.read_through(spark, str(tmp_path / "c2"), str(tmp_path / "none"), lambda: good)


def test_views_of_the_caller_stay(spark):
    df = spark.range(3)
    spark.range(5).createOrReplaceTempView("held")
    assert sources.sql_scalar(df, "held", "SELECT count(*) FROM held") == 3 and spark.table("held").count() == 5
    later = sources.sql_view(df, "only_now", "SELECT * FROM only_now")
    assert not spark.catalog.tableExists("only_now") and later.count() == 3
