import io
import json
import zipfile

from tesserae.sources import readers, tables
from tesserae.sources.scratch import scratch_path

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>he</t><t>ad</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
    return out.getvalue()


def test_workbook_cells(spark):
    files = spark.createDataFrame([("a.xlsx", workbook()), ("b.xlsx", b"no")], "path string, content binary")
    rows = [tuple(r) for r in readers.read_workbooks(files).collect()]
    assert rows == [("a.xlsx", "One", 1, ["head", None, "2"]), ("a.xlsx", "One", 3, ["in"])]


def test_page_images(spark):
    def render(data):
        if data == b"bad":
            raise ValueError("not a document")
        return [data, None]

    files = spark.createDataFrame([("a", b"x"), ("b", b"bad")], "path string, content binary")
    assert [tuple(r) for r in readers.page_images(files, render).collect()] == [("a", 1, "eA=="), ("a", 2, None)]


def test_files_logs_results_exports(spark, tmp_path):
    from tesserae.operators.ingest import list_files

    (tmp_path / "in").mkdir()
    for name in ("b.TXT", "a.pdf", "c.png"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert [r["path"].rsplit("/")[-1] for r in list_files(spark, f"file://{tmp_path}/in").collect()] == ["a.pdf", "b.TXT"]
    (tmp_path / "r").mkdir()
    for stamp, ok in (("20240101_000000", False), ("20240102_000000", True)):
        (tmp_path / "r" / f"results_{stamp}.json").write_text(json.dumps({"scenario_id": 1, "passed": ok}))
    assert [r["passed"] for r in readers.latest_results(spark, f"file://{tmp_path}/r").collect()] == [True]
    (tmp_path / "x.log").write_text("one\ntwo")
    assert [(r["line_no"], r["text"]) for r in tables.read_log(spark, f"file://{tmp_path}/x.log").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "u.csv").write_text("date,model,input_tokens,output_tokens,total_tokens,cost\n2024-01-01,m,1,2,3,0.5\n")
    assert tables.read_usage_csv(spark, f"file://{tmp_path}/u.csv").first()["total_tokens"] == 3
    out = scratch_path(spark, "csv")
    readers.export_csv({"t": spark.createDataFrame([(True, None, [1])], "a boolean, b string, c array<int>")}, out)
    assert tuple(spark.read.csv(f"{out}/t", header=True).fillna("").first()) == ("True", "", "[1]")
