"""Readers, writers and the driver contract."""

import io
import zipfile

import pytest

import __spark_entry__ as E
from tablewright.sources import readers as RD


def test_csv_na_tokens_and_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c\n1,2.5,x\nNA,3.5,N/A\n3,,y\n")
    df = RD.read_table(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert df.where("a is null").count() == 1 and df.where("c is null").count() == 1


def test_json_array_document(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"a":1,"b":2},{"a":3,"b":4}]')
    assert RD.read_table(spark, str(p)).count() == 2


def _xlsx_bytes(rows):
    sheet = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
                                      for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    xml = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
           + sheet + "</sheetData></worksheet>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", xml)
    return buf.getvalue()


def test_xlsx_reader(spark, tmp_path):
    p = tmp_path / "book.xlsx"
    p.write_bytes(_xlsx_bytes([["x", "y"], ["1", "a"], ["2", "b"]]))
    df = RD.read_table(spark, str(p))
    assert df.count() == 2 and dict(df.dtypes)["x"] == "bigint"


def test_unknown_extension_rejected(spark):
    with pytest.raises(ValueError):
        RD.read_table(spark, "/tmp/data.txt")


def test_entry_and_contract(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 4
    assert set(E.oracle_sql()) <= set(E.queries())
