"""Readers, column mapping and export."""

import io
import os
import tempfile
import zipfile

import pytest

from riskweave.sources.mapping import (apply_mapping, load_mapping, mapping_confidence, mapping_report,
                                       normalize_columns, override_mapping, resolve_mapping, save_mapping,
                                       unmapped_columns, validate_required, validate_schema)
from riskweave.sources.readers import detect_format, read_transactions, read_workbooks
from riskweave.sources.sinks import export_frame


def test_normalize_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], "` Tx ID` long, `Amount` long")
    assert normalize_columns(df).columns == ["tx_id", "amount"]
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([(1, 2)], "`A b` long, `a_b` long"))


def test_resolve_exact_fuzzy_ambiguous():
    cols = ["tx_id", "shuma_e_transaksionit", "banka_derguese", "data_transaksionit", "sender_acct"]
    m = resolve_mapping(cols)
    assert m.columns["transaction_id"] == "tx_id" and m.method["amount"] == "exact"
    assert m.columns["sender_id"] == "sender_acct" and m.method["sender_id"] == "fuzzy"
    # receiver_bank would fuzzy-match banka_derguese, already claimed by sender_bank
    assert m.columns["receiver_bank"] is None and m.ambiguous["receiver_bank"] == "banka_derguese"
    conf = mapping_confidence(m, cols)
    assert conf["amount"] == 1.0 and 0.6 <= conf["sender_id"] < 1.0 and conf["currency"] == 0.0


def test_only_receiver_column_not_claimed_twice():
    m = resolve_mapping(["receiver_id", "amount", "timestamp"])
    assert m.columns["receiver_id"] == "receiver_id" and m.columns["sender_id"] is None


def test_override_and_validate(spark):
    m = override_mapping({"amount": "Shuma", "timestamp": "(Not Mapped)", "sender_id": "nope"}, ["shuma", "x"])
    assert m.columns["amount"] == "shuma" and m.columns["timestamp"] is None and m.columns["sender_id"] is None
    assert validate_required(m) == (False, ["timestamp"])
    df = spark.createDataFrame([(1.0, "x")], "Shuma double, x string")
    mapped = apply_mapping(df, m)
    assert mapped.columns == ["amount"] and validate_schema(mapped) == (False, ["timestamp"])
    assert unmapped_columns(df, m) == ["x"]
    assert apply_mapping(df, override_mapping({}, df.columns)).columns == []


def test_mapping_roundtrip_and_report(spark):
    cols = ["tx_id", "amount", "date"]
    m = resolve_mapping(cols)
    d = tempfile.mkdtemp(prefix="rw-map-")
    save_mapping(spark, m, d + "/m")
    assert load_mapping(spark, d + "/m").columns == m.columns
    rep = {r["canonical"]: r for r in mapping_report(spark, m, cols).collect()}
    assert rep["amount"]["required"] and rep["timestamp"]["mapped_column"] == "date"


def test_read_csv_as_text(spark):
    d = tempfile.mkdtemp(prefix="rw-csv-")
    p = os.path.join(d, "feed.csv")
    with open(p, "w") as f:
        f.write("Tx ID,Amount,Date\n1,100.5,2024-01-01 10:00:00\n2,n/a,bad\n")
    df = read_transactions(spark, p)
    assert dict(df.dtypes) == {"Tx ID": "string", "Amount": "string", "Date": "string"}
    assert df.count() == 2
    with pytest.raises(ValueError):
        detect_format("feed.txt")


def _xlsx(rows) -> bytes:
    """A minimal workbook (inline strings, numbers, (number, style) pairs) for the reader test."""
    def cell(ref, v):
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="{v[1]}"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r) if v is not None)
                   + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" '
                   'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd\\.mm\\.yyyy"/>'
                   '<numFmt numFmtId="171" formatCode="[Red]0.00&quot; days&quot;"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return buf.getvalue()


def test_read_workbooks(spark):
    d = tempfile.mkdtemp(prefix="rw-xlsx-")
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_xlsx([["tx_id", "amount"], [1, 10.5], [2, None]]))
    with open(os.path.join(d, "b.xlsx"), "wb") as f:
        f.write(_xlsx([["tx_id", "amount", "currency"], [3, 7, "EUR"]]))
    df = read_workbooks(spark, d + "/*.xlsx")
    rows = sorted(tuple(r) for r in df.select("tx_id", "amount", "currency").collect())
    assert rows == [("1", "10.5", None), ("2", None, None), ("3", "7", "EUR")]


def test_workbook_dates_and_repeated_headers(spark):
    d = tempfile.mkdtemp(prefix="rw-xlsx-")
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_xlsx([["when", "amount", "amount"], [(45366.125, 1), (45366, 2), (1.5, 3)], [(45366.125, 0), None, "x"]]))
    df = read_workbooks(spark, d + "/*.xlsx")
    assert df.columns == ["when", "amount", "amount.1"]
    assert sorted(map(tuple, df.collect()), key=str) == [
        ("2024-03-15 03:00:00", "2024-03-15 00:00:00", "1.5"), ("45366.125", None, "x")]


def test_export_modes(spark):
    df = spark.createDataFrame([(1, 0.9, 1, 1, 3.0, "x"), (2, 0.1, 0, 0, 0.0, "y")],
                               "transaction_id long, aml_score double, anomaly_label int, is_flagged int, "
                               "enhanced_aml_score double, currency string")
    assert export_frame(df, "flagged").count() == 1
    assert export_frame(df, "original").columns == ["transaction_id", "currency"]
    assert export_frame(df, "input").columns == ["transaction_id", "currency"]
    assert export_frame(df.drop("is_flagged"), "flagged").count() == 2
