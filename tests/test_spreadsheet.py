import io
import zipfile

from ledgerloom.sources import delimited, spreadsheet

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets, shared=(), extra=None):
    """A workbook of (name, rows as XML)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(shared) + "</sst>")
        for k, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        for name, body in (extra or {}).items():
            z.writestr(name, body)
    return out.getvalue()


ROWS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Label</t></is></c><c r="C1" t="str"><v>Sum</v></c></row>
<row r="3"><c r="A3" s="1"><v>45689</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" s="3"><f>1+1</f><v>-12.5</v></c></row>
<row r="4"><c r="A4" s="2"><v>45690.5</v></c><c r="C4"><v>3</v></c><c r="D4" t="b"><v>1</v></c></row>"""
SHARED = ("<si><t>Day</t></si>", "<si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si>")


def test_cells_of_a_workbook(spark):
    book = workbook([("cover", ""), ("moves", ROWS), ("other", '<row><c><v>7</v></c><c t="e"><v>#N/A</v></c></row>')], SHARED)
    df = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(b"no zip")), ("c", None), ("d", bytearray(workbook([("cover", "")])))], "path string, content binary")
    got = spreadsheet.read_spreadsheets(df).orderBy("path", "pos").collect()
    assert [r["cells"] for r in got if r["path"] == "a"] == [["Day", "Label", "Sum", ""], [""] * 4, ["2025-02-01", "two runs", "-12.5", ""], ["2025-02-02 12:00:00", "", "3", "true"]]
    assert {(r["path"], r["problem"]) for r in got if r["problem"]} == {("b", "unreadable"), ("c", "unreadable"), ("d", "empty")}
    assert got[0]["sheet"] == "moves" and got[0]["sheets"] == ["moves", "other"]
    asked = spreadsheet.read_spreadsheets(df.filter("path = 'a'"), "other").collect()
    assert [r["cells"] for r in asked] == [["7", "#N/A"]]
    rows = spreadsheet.read_spreadsheets(df.filter("path = 'a'"))
    assert {r["record"]["Sum"] for r in delimited.records(rows, 0).collect()} == {"-12.5", "3"}


def test_limits_of_a_workbook():
    for rows, reason in (('<row r="50001"><c><v>1</v></c></row>', "too many rows"), ('<row r="1"><c r="ALM1"><v>1</v></c></row>', "too many columns"), ('<row r="1"><c t="s"><v>9</v></c></row>', "unreadable"), ('<row r="1"><c><v>x</v></c></row>', "unreadable")):
        try:
            spreadsheet.read_workbook(workbook([("s", rows)]))
            raise AssertionError(reason)
        except spreadsheet.Unreadable as error:
            assert str(error) == reason
    try:
        spreadsheet.read_workbook(workbook([("s", ROWS)], SHARED, {"big": bytes(51 << 20)}))
        raise AssertionError("too large")
    except spreadsheet.Unreadable as error:
        assert str(error) == "too large"
