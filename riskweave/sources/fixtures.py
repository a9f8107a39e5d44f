"""Transaction fixtures derived by Spark from the driver tables.

``txn`` is one payment per ``events`` row, joined to ``customer`` (sender
side) and ``supplier`` (receiver side); ``txn_raw`` is the same rows as a
dirty text upload under raw headers. Both read the whole tables, so their
work grows with the scale factor. Modulus rules below only *place* faults
(bad amounts, nulls, duplicates) deterministically; no rows are dropped.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import read_table

# Nation key + 1 -> ISO-2 country used by the fixtures.
COUNTRY_LIST = "XK,AL,DE,CH,IR,US,XK,TR,CO,IT,MX,FR,NG,RS,MK,GB,AT,LA,SE,HR,AF,XK,ME,SI,PE"


def _country(nationkey: Column) -> Column:
    return F.split_part(F.lit(COUNTRY_LIST), F.lit(","), (nationkey + 1).cast("int"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Scalar subquery (one value), not a cross join.
    n_sup = sup.select(F.count(F.lit(1))).scalar()
    e = ev.withColumn("_supp", (F.col("event_id") * 37 + F.col("user_id")) % n_sup)
    # Equi-joins; Catalyst/AQE choose shuffle or (size-checked) broadcast.
    j = e.join(cust, e["user_id"] == cust["c_custkey"]).join(sup, e["_supp"] == sup["s_suppkey"])
    return j.select(
        F.col("event_id").alias("transaction_id"),
        (F.col("value") * 60).alias("amount"),
        F.col("user_id").alias("sender_id"),
        F.col("s_suppkey").alias("receiver_id"),
        F.col("c_mktsegment").alias("sender_bank"),
        F.when(F.col("event_id") % 250 == 0,
               F.concat(F.lit("BANK_R"), F.col("event_id").cast("string")))
         .otherwise(F.concat(F.lit("BANK_"), (F.col("s_suppkey") % 7).cast("string")))
         .alias("receiver_bank"),
        _country(F.col("c_nationkey")).alias("sender_country"),
        _country(F.col("s_nationkey")).alias("receiver_country"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("transaction_type"),
        F.lit("EUR").alias("currency"),
    )


def _raw_projection(ev: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    whole = F.floor(F.col("value") * 60).cast("bigint").cast("string")
    return ev.select(
        eid.cast("string").alias("tx_id"),
        F.when(eid % 97 == 0, F.lit("n/a"))
         .when(eid % 89 == 0, F.concat(F.lit("-"), whole))
         .otherwise(whole).alias("shuma_e_transaksionit"),
        F.when(eid % 101 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("user_id").cast("string")).alias("id_i_llogarise_se_derguesit"),
        ((eid * 37 + F.col("user_id")) % 10).cast("string").alias("id_i_llogarise_se_perfituesit"),
        F.when(eid % 53 == 0, F.lit(None).cast("string")).otherwise(F.lit("banka a")).alias("banka_derguese"),
        F.when(eid % 3 == 0, F.lit(" xk "))
         .when(eid % 59 == 0, F.lit(None).cast("string"))
         .otherwise(F.lit("NA")).alias("lokacioni_i_derguesit"),
        F.lit("de").alias("lokacioni_i_perfituesit"),
        F.when(eid % 103 == 0, F.lit("bad-date"))
         .otherwise(F.date_trunc("second", F.col("ts")).cast("string")).alias("data_transaksionit"),
        F.when(eid % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("tx_type"),
    )


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty upload: text columns, raw headers, faults, full-row duplicates."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = _raw_projection(ev)
    dups = _raw_projection(ev.where(F.col("event_id") % 50 == 0))
    return rows.unionByName(dups)


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet: header texts are shared strings, cells are inline texts, absent ones left out."""
    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    heads = "".join(f'<c r="{letters(j)}1" t="s"><v>{j}</v></c>' for j in range(len(header)))
    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{letters(j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                                   for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 2))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_RELATION}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}">' + "".join(f"<si><t>{escape(h)}</t></si>" for h in header) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData><row r="1">{heads}</row>{body}</sheetData></worksheet>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def txn_workbooks(spark: SparkSession, sf_dir: str, headers: dict[str, str], rows_each: int = 2_000) -> DataFrame:
    """``txn_raw`` as workbooks (path, content) of about ``rows_each`` rows; every other one has its columns in
    reverse order under ``headers`` (raw name -> name there)."""
    raw = txn_raw(spark, sf_dir)
    file = F.floor(F.col("tx_id").cast("bigint") / rows_each)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c for c in pdf.columns if c != "_file"]
        names = names[::-1] if key[0] % 2 else names
        rows = [tuple(None if v is None else str(v) for v in r) for r in pdf[names].itertuples(index=False)]
        head = [headers.get(c, c) if key[0] % 2 else c for c in names]
        return pd.DataFrame({"path": [f"upload{key[0]}.xlsx"], "content": [workbook(head, rows)]})
    return raw.withColumn("_file", file).groupBy("_file").applyInPandas(pack, "path string, content binary")
