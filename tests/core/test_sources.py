import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.ledger import normalise
from tallyloom.plans.uploads import process_folder
from tallyloom.sources import files
from tallyloom.sources.sheets import sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
ROWS = [["Posted Date", "Memo", "Deposits", "Withdrawals", "Balance"], ["2024-01-05", "SALE & more", "1,200.50", None, "9.00"], None, ["2024-01-06", "KAPITUS ACH DEBIT", None, "50", "7.25"]]


def workbook(rows, date1904=False):
    """A workbook of text, shared strings, numbers and dates, with an empty row between."""
    shared, sheet = [], []
    for n, row in enumerate(rows, 1):
        if row is None:
            continue
        cells = []
        for k, v in enumerate(row):
            at = f"{chr(65 + k)}{n}"
            if v is None:
                continue
            if n > 1 and k == 0:  # a date as a serial number: 45296 is 2024-01-05
                serial = 45296 + int(v[-2:]) - 5 - (1462 if date1904 else 0)
                cells.append(f'<c r="{at}" s="1"><v>{serial}</v></c>')
            elif v.replace(".", "").isdigit():
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif k % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v.replace("&", "&amp;")}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        sheet.append(f'<row r="{n}">{"".join(cells)}</row>')
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} {RELS}><workbookPr{" date1904=\"1\"" if date1904 else ""}/><sheets><sheet name="a" sheetId="1" r:id="rId7"/><sheet name="b" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId8" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="[$-409]yyyy\\-mm\\-dd;@"/></numFmts><cellStyleXfs><xf numFmtId="0"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst {MAIN}>' + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:].replace('&', '&amp;')}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData>{"".join(sheet)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("date1904", [False, True])
def test_sheet_rows(date1904):
    got = [*sheet_rows(workbook(ROWS, date1904))]
    assert got == [(1, ROWS[0]), (2, ["2024-01-05", "SALE & more", "1,200.50", None, "9.00"]), (4, ["2024-01-06", "KAPITUS ACH DEBIT", None, "50", "7.25"])]


def test_files_with_different_headers_and_sheets_give_one_ledger(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Date,Description,Debit,Credit\n2024-01-05,"SALE, ""big""\nand long",,100.00\n\n2024-01-06,RENT,50.00,\n')
    (tmp_path / "two.CSV").write_text("﻿Credit,Branch,Date,Details,Debit,Balance,Value Date\n$7.00,x,2024-02-01,PAY,,12.5,2030-01-01\n,x,2024-02-02,FEE,2.00,10.5,2030-01-01\n")
    (tmp_path / "three.csv").write_text("Posted Date,Memo,Amount (USD)\n2024-03-01,IN,9.00\n2024-03-02,OUT,(4.00)\n")
    (tmp_path / "four.csv").write_text("Date,Description,Debit,Credit\n")
    (tmp_path / "sheet.xlsx").write_bytes(workbook(ROWS))
    path = f"file://{tmp_path}"
    raw = files.csv_ledgers(spark, f"{path}/*.[cC][sS][vV]").unionByName(files.xlsx_ledgers(files.uploads(spark, path)))
    got = sorted((r.statement, r.Date, r.Description, r.Debit, r.Credit, r.Balance) for r in normalise(raw).collect())
    assert got == [
        ("one.csv", "2024-01-05", 'SALE, "big"\nand long', 0.0, 100.0, 0.0), ("one.csv", "2024-01-06", "RENT", 50.0, 0.0, 0.0),
        ("sheet.xlsx", "2024-01-05", "SALE & more", 0.0, 1200.5, 9.0), ("sheet.xlsx", "2024-01-06", "KAPITUS ACH DEBIT", 50.0, 0.0, 7.25),
        ("three.csv", "2024-03-01", "IN", 0.0, 9.0, 0.0), ("three.csv", "2024-03-02", "OUT", 4.0, 0.0, 0.0),
        ("two.CSV", "2024-02-01", "PAY", 0.0, 7.0, 12.5), ("two.CSV", "2024-02-02", "FEE", 2.0, 0.0, 10.5),
    ]


def test_a_file_of_too_many_columns_is_an_error(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(["Date"] * 200) + "\n" + ",".join(["1"] * 200) + "\n")
    with pytest.raises(Exception, match="more than 100 columns"):
        files.csv_ledgers(spark, f"file://{tmp_path}").collect()


def tiers(log):
    def tier(name, least, texts):
        def make():
            def extract(file, content):
                with open(log, "a") as f:
                    f.write(f"{name} {file}\n")
                if texts.get(file) is None:
                    raise ValueError(f"no {file}")
                return texts[file]

            return extract

        return files.Tier(name, least, make)

    return [tier("digital", 5, {"a.pdf": "long enough", "b.pdf": " xy  ", "c.pdf": None}), tier("neural", 3, {"b.pdf": "  xyz", "c.pdf": "z"}), tier("plain", 0, {"c.pdf": None})]


def test_tiers_see_only_what_the_ones_before_left(spark, tmp_path):
    data = spark.createDataFrame([(f"{c}.pdf", bytearray(b"x")) for c in "abc"], "statement string, content binary")
    got = files.extracted(data, tiers(str(tmp_path / "log")))
    rows = {r.statement: r for r in got.collect()}
    assert got.count() == 3  # reading the result again runs nothing again
    assert (rows["a.pdf"].text, rows["a.pdf"].tier, rows["a.pdf"].errors) == ("long enough", "digital", [])
    assert (rows["b.pdf"].text, rows["b.pdf"].tier) == ("  xyz", "neural")
    assert (rows["c.pdf"].text, rows["c.pdf"].tier, rows["c.pdf"].errors) == ("", "plain", ["digital: ValueError: no c.pdf", "plain: ValueError: no c.pdf"])
    assert sorted((tmp_path / "log").read_text().splitlines()) == ["digital a.pdf", "digital b.pdf", "digital c.pdf", "neural b.pdf", "neural c.pdf", "plain c.pdf"]


def test_a_folder_to_metrics(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "jan.csv").write_text("Date,Description,Debit,Credit,Balance\n2024-01-05,SALE,,100.00,100.00\n2024-01-06,KAPITUS ACH DEBIT,50.00,,50.00\n")
    (tmp_path / "in" / "book.xlsx").write_bytes(workbook(ROWS))
    (tmp_path / "in" / "s.pdf").write_bytes(b"01/05/2024 SHOP 12.50\n01/06/2024 DEPOSIT 30.00")
    (tmp_path / "in" / "p.png").write_bytes(b"01/07/2024 SHOP 1.50")
    (tmp_path / "in" / "skipped.txt").write_text("x")
    broken = files.Tier("broken", 1, lambda: lambda name, content: 1 / 0)
    plain = files.Tier("plain", 0, lambda: files.plain_text)
    got = process_folder(spark, f"file://{tmp_path}/in", F.lit(2024), [broken, plain], [plain])
    rows = {r.statement: (r.credits, r.debits, r.avg_daily_balance) for r in got["metrics"].collect()}
    assert rows == {"jan.csv": (100.0, 50.0, 75.0), "book.xlsx": (1200.5, 50.0, 8.13), "s.pdf": (42.5, 0.0, 21.25), "p.png": (1.5, 0.0, 1.5)}
    assert [(r.statement, r.error) for r in got["errors"].collect()] == [("s.pdf", "broken: ZeroDivisionError: division by zero")]


def test_packed_csv_files_are_read_as_files_are(spark, tmp_path, monkeypatch):
    texts = {
        "a.csv": '﻿Date,Description,Debit,Credit\n2024-01-02,"A, ""b""\nmore",5.00,\n\n2024-01-03,B,,6.00,7\n', "b.csv": "Deposits,Memo,Branch,Withdrawals,Posted Date\r\n$1.00,C,x,,2024-01-04\r\n$2.00,D\r\n",
        "none.csv": "", "head.csv": "Date,Amount\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    monkeypatch.setattr(files, "_AT_ONCE", 1)
    rows = lambda df: sorted(tuple(r) for r in df.drop("row_no").collect())
    packed = files.packed_csv_ledgers(spark.createDataFrame([(n, t.encode()) for n, t in [*texts.items(), ("c.txt", "Date\nx")]], "statement string, content binary"))
    assert rows(packed) == rows(files.csv_ledgers(spark, f"{tmp_path}/*.csv")) and packed.count() == 4
    assert [r.row_no for r in packed.filter("statement = 'a.csv'").orderBy("row_no").collect()] == [1, 2]


def test_ledgers_are_not_a_folder_a_statement(spark, tmp_path, monkeypatch):
    from tallyloom import queries_banks

    spark.createDataFrame([(k, datetime.datetime(2024, 1, 5), k, "click", 5.0) for k in range(50)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries_banks, "folder", lambda _: f"{tmp_path}/cuts")
    assert queries_banks.q_csv_ledgers(spark, f"{tmp_path}").count() == 50
    assert sum(len(d) for _, d, _ in os.walk(tmp_path / "cuts")) == 1
