import os
import tempfile
import zipfile

import pytest

from panelcast.sources.workbook import read_workbooks

SHEET = """<?xml version="1.0" encoding="UTF-8"?>
<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>
<row r="2"><c r="A2" s="1"><v>43983</v></c><c r="B2" t="s"><v>3</v></c><c r="C2" t="s"><v>4</v></c></row>
<row r="3"><c r="A3" s="1"><v>43984</v></c><c r="B3" t="s"><v>3</v></c><c r="C3"><v>1.5</v></c></row>
</sheetData></worksheet>"""
WB = """<?xml version="1.0" encoding="UTF-8"?>
<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
<sheets><sheet name="2012-2022_surface" sheetId="1" r:id="rId1"/></sheets></workbook>"""
RELS = """<?xml version="1.0" encoding="UTF-8"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Target="worksheets/sheet1.xml"
 Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>"""
STRINGS = """<?xml version="1.0" encoding="UTF-8"?>
<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<si><t>Sample Date</t></si><si><t>Site</t></si><si><t>Extracted Chlorophyll a (ug/L)</t></si>
<si><t>WE2</t></si><si><t>&lt;0.05</t></si></sst>"""
STYLES = """<?xml version="1.0" encoding="UTF-8"?>
<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>"""


def _write(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", WB)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/sharedStrings.xml", STRINGS)
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_read_workbook_as_strings(spark):
    d = tempfile.mkdtemp(prefix="pc-xlsx-", dir="/tmp")
    _write(os.path.join(d, "a.xlsx"))
    df = read_workbooks(spark, d + "/*.xlsx", "2012-2022_surface").orderBy("row")
    rows = df.collect()
    assert df.columns[3:] == ["Sample Date", "Site", "Extracted Chlorophyll a (ug/L)"]
    assert [(r["Sample Date"], r["Site"], r["Extracted Chlorophyll a (ug/L)"]) for r in rows] == [
        ("2020-06-01", "WE2", "<0.05"), ("2020-06-02", "WE2", "1.5")]


def test_damaged_workbook_names_the_path(spark):
    d = tempfile.mkdtemp(prefix="pc-xlsx-", dir="/tmp")
    with open(os.path.join(d, "bad.xlsx"), "wb") as f:
        f.write(b"not a zip")
    with pytest.raises(ValueError, match="bad.xlsx"):
        read_workbooks(spark, d + "/*.xlsx")


def test_columns_are_named_by_their_own_workbook(spark):
    d = tempfile.mkdtemp(prefix="pc-xlsx-", dir="/tmp")
    _write(os.path.join(d, "a.xlsx"))
    turned = SHEET.replace('r="B1" t="s"><v>1</v>', 'r="B1" t="s"><v>2</v>').replace('r="C1" t="s"><v>2</v>', 'r="C1" t="s"><v>1</v>')
    with zipfile.ZipFile(os.path.join(d, "a.xlsx")) as old, zipfile.ZipFile(os.path.join(d, "b.xlsx"), "w") as new:
        for name in old.namelist():
            new.writestr(name, turned if name.endswith("sheet1.xml") else old.read(name))
    rows = read_workbooks(spark, d + "/*.xlsx", "2012-2022_surface").collect()
    for r in rows:
        assert (r["Site"] == "WE2") == r["path"].endswith("a.xlsx")
    assert len(rows) == 4
