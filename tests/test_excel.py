import zipfile

import pytest

from coordspark.sources import excel
from coordspark.sources.texts import FileTooLarge

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, strings=(), styles="", late=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tags = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://x/r"><workbookPr date1904="{int(late)}"/><sheets>{tags}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="/xl/worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for k, rows in enumerate(sheets.values()):
            with z.open(f"xl/worksheets/s{k}.xml", "w") as f:
                f.write(f"<worksheet {MAIN}><sheetData>".encode())
                for row in rows:
                    f.write(f"<row>{row}</row>".encode())
                f.write(b"</sheetData></worksheet>")


STRINGS = ("<t>Nome</t>", "<r><t>a &amp; </t></r><r><t>b</t></r><rPh><t>no</t></rPh>", "<t xml:space='preserve'> x </t>")
STYLES = '<numFmts><numFmt numFmtId="200" formatCode="yyyy-mm"/><numFmt numFmtId="201" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/><xf numFmtId="201"/></cellXfs>'
HEAD = '<c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>d</t></is></c>'
ROWS = [HEAD, '<c r="A2" t="s"><v>1</v></c><c r="B2"><v>7.0</v></c><c r="C2" s="1"><v>45292</v></c><c r="AA2" t="b"><v>1</v></c>', "", '<c t="s"><v>2</v></c><c><v>0.1</v></c><c r="C4" s="2"><v>45292.5</v></c><c r="D4" t="e"><v>#N/A</v></c>', '<c r="C5" s="1"><v>0.25</v></c><c r="D5" s="3"><v>1.5</v></c>']


def found(rows):
    return [[c for c in r.cells] for r in rows.orderBy("row_id").collect()]


def test_cells_of_a_sheet(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"um": ["<c><v>1</v></c>"], "dois": ROWS}, STRINGS, STYLES)
    rows, heads = excel.read(spark, str(tmp_path), "dois")
    assert heads.first().names == ["Nome", "Unnamed: 1", "d", *(f"Unnamed: {k}" for k in range(3, 27))]
    got = [r[:4] + r[26:] for r in found(rows)]
    assert got == [["a & b", "7", "2024-01-01", "", "TRUE"], ["", "", "", "", ""], [" x ", "0.1", "2024-01-01 12:00:00", "#N/A", ""], ["", "", "06:00:00", "1.5", ""]]
    assert [(r.sheet_no, r.sheet) for r in excel.sheets(spark, str(tmp_path)).orderBy("sheet_no").collect()] == [(0, "um"), (1, "dois")]
    assert excel.read(spark, str(tmp_path))[1].first().names == ["1"] and excel.read(spark, str(tmp_path), "none")[0].count() == 0


def test_the_later_epoch_and_limits(spark, tmp_path):
    book(tmp_path / "a.xlsm", {"s": ['<c><v>x</v></c>', '<c s="1"><v>43830</v></c>']}, (), STYLES, late=True)
    assert found(excel.read(spark, str(tmp_path))[0]) == [["2024-01-01"]]
    with pytest.raises(Exception, match="bytes expanded"):
        excel.read(spark, str(tmp_path), most=100)[0].count()
    (tmp_path / "b.xls").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"x" * 100)
    with pytest.raises(Exception, match="old workbooks"):
        excel.read(spark, str(tmp_path / "b.xls"))[0].count()
    assert issubclass(FileTooLarge, ValueError)


def test_a_sheet_passes_in_batches(spark, tmp_path):
    n = 3 * excel.BATCH_ROWS + 5
    book(tmp_path / "a.xlsx", {"s": (f'<c t="s"><v>{k % 2}</v></c><c><v>{k}</v></c>' for k in range(n))}, ("<t>even</t>", "<t>odd</t>"))
    rows, heads = excel.read(spark, str(tmp_path))
    assert heads.first().names == ["even", "0"] and rows.count() == n - 1
    assert {tuple(r.cells) for r in rows.where("row_id in (0, 4095, 4096, 12291)").collect()} == {("odd", "1"), ("even", "4096"), ("odd", "4097"), ("even", "12292")}
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        sizes = [b.num_rows for b in excel._rows(0)("s", z)]
    assert sizes == [excel.BATCH_ROWS] * 3 + [5]
