"""Many files, few layouts. S2: workbooks opened once and streamed."""

import io
import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave.sources import readers as R
from riskweave.sources.fixtures import workbook
from riskweave.sources.mapping import load_and_map, mapped_workbooks
from riskweave.session import cut_lineage
from tests.test_sources import _xlsx

LAYOUTS = [["tx_id", "amount", "date"], ["Amount", "Tx ID", "Timestamp"], ["shuma_e_transaksionit", "tx_id"],
           ["tx_id", "Amount", "currency", "unknown thing"], ["Transaction ID", "AMOUNT"]]


def write_feeds(folder, n):
    for i in range(n):
        names = LAYOUTS[i % len(LAYOUTS)]
        cells = {"tx_id": i, "Tx ID": i, "Transaction ID": i, "currency": "CHF", "unknown thing": "?", "date": "2024-01-02 03:04:05",
                 "Timestamp": "2024-01-02 03:04:05"}
        with open(os.path.join(folder, f"feed{i:04d}.csv"), "w") as f:
            f.write(("﻿" if i % 7 == 0 else "") + ",".join(f'"{c}"' if i % 3 == 0 else c for c in names) + "\n")
            f.write(",".join(str(cells.get(c, f"{i}.5")) for c in names) + "\n")


def test_a_thousand_files_of_five_layouts_are_five_scans(spark, tmp_path):
    write_feeds(str(tmp_path), 1000)
    out, maps = load_and_map(spark, [str(tmp_path / "*.csv")], "csv", feed_col="feed")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 5 and len(maps) == 1000
    got = {int(r["transaction_id"]): r.asDict() for r in out.collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r["amount"] == f"{i}.5" and r["feed"].endswith(f"feed{i:04d}.csv")
        assert r["currency"] == ("CHF" if i % 5 == 3 else None)
        assert r["timestamp"] == ("2024-01-02 03:04:05" if i % 5 in (0, 1) else None)


def test_paths_of_one_layout_have_one_mapping(spark, tmp_path):
    for name, head in (("a.csv", "tx_id,amount"), ("b.csv", "Tx ID,Amount"), ("c.csv", "tx_id,amount")):
        (tmp_path / name).write_text(f"{head}\n1,2\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    out, maps = load_and_map(spark, paths)
    assert set(maps) == set(paths) and maps[paths[0]] is maps[paths[2]]
    assert sorted(map(tuple, out.collect())) == [("1", "2")] * 3
    with pytest.raises(FileNotFoundError):
        load_and_map(spark, [str(tmp_path / "none.csv")], "csv")
    with pytest.raises(ValueError):
        load_and_map(spark, [str(tmp_path / "a.txt")])


def test_awkward_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a`b,Amount,amount,"x, ""y"""\n1,2,3,4\n')
    df = R.read_csv_files(spark, [str(tmp_path / "a.csv")], tuple(R.csv_header(spark, str(tmp_path / "a.csv"))))
    assert df.columns == ["a`b", "Amount", "amount.1", 'x, "y"'] and tuple(df.first()) == ("1", "2", "3", "4")
    (tmp_path / "empty.csv").write_text("")
    assert R.csv_header(spark, str(tmp_path / "empty.csv")) == []


def test_parquet_feeds_by_schema(spark, tmp_path):
    for i in range(4):
        names = "tx_id long, amount double" if i % 2 else "`Tx ID` long, Amount double"
        spark.createDataFrame([(i, 1.5)], names).write.parquet(str(tmp_path / f"p{i}.parquet"))
    out, maps = load_and_map(spark, [str(tmp_path / f"p{i}.parquet") for i in range(4)])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert sorted(map(tuple, out.collect())) == [(i, 1.5) for i in range(4)] and len(maps) == 4


# ---- workbooks
def folder_of(tmp_path, books):
    for name, data in books.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path / "*.xlsx")


def test_workbooks_are_opened_once(spark, tmp_path, monkeypatch):
    glob = folder_of(tmp_path, {f"b{i}.xlsx": _xlsx([["tx_id", "amount"], [i, i + 0.5]]) for i in range(6)})
    opened = spark.sparkContext.accumulator(0)
    plain = R.workbook_rows

    def counted(files):
        @F.udf("binary")
        def look(content):
            opened.add(1)
            return content
        return plain(files.withColumn("content", look.asNondeterministic()("content")))
    monkeypatch.setattr(R, "workbook_rows", counted)
    df = R.read_workbooks(spark, glob)
    assert sorted(map(tuple, df.collect())) == [(str(i), str(i + 0.5)) for i in range(6)]
    assert df.count() == 6 and opened.value == 6


def test_layouts_headers_and_empty_sheets(spark, tmp_path):
    glob = folder_of(tmp_path, {
        "a.xlsx": _xlsx([["Tx`Id", "Amount"], [1, 2]]), "b.xlsx": _xlsx([["amount", "tx`id", "amount"], [3, 4, 5]]),
        "c.xlsx": _xlsx([["only", "header"]]), "d.xlsx": _xlsx([])})
    df = R.read_workbooks(spark, glob)
    assert [c.lower() for c in df.columns] == ["tx`id", "amount", "only", "header", "amount.1"]
    named = {c.lower(): i for i, c in enumerate(df.columns)}
    rows = sorted(((r[named["tx`id"]], r[named["amount"]], r[named["amount.1"]]) for r in df.collect()), key=str)
    assert rows == [("1", "2", None), ("4", "3", "5")]
    none = tmp_path / "none"
    none.mkdir()
    folder_of(none, {"e.xlsx": _xlsx([])})
    assert R.read_workbooks(spark, str(none / "*.xlsx")).count() == 0


def test_workbook_feeds_map_by_layout(spark, tmp_path):
    glob = folder_of(tmp_path, {"a.xlsx": _xlsx([["tx_id", "amount"], [1, 2]]), "b.xlsx": _xlsx([["Amount", "currency", "Tx ID"], [7, "EUR", 9]]),
                                "c.xlsx": _xlsx([["tx_id", "amount"], [5, 6], [8, None]])})
    out, maps = load_and_map(spark, [glob], "xlsx", feed_col="feed")
    got = sorted((r["transaction_id"], r["amount"], r["currency"], r["feed"][-6:]) for r in out.collect())
    assert got == [("1", "2", None, "a.xlsx"), ("5", "6", None, "c.xlsx"), ("8", None, None, "c.xlsx"), ("9", "7", "EUR", "b.xlsx")]
    assert len(maps) == 3
    table = cut_lineage(R.workbook_rows(spark.read.format("binaryFile").load(glob)))
    assert len(mapped_workbooks(table)[0]) == 2


def test_rows_of_a_large_sheet_are_streamed():
    """A hundred thousand rows: what is held does not grow with the sheet."""
    def peak(n):
        data = workbook(["tx_id", "amount", "note"], [(str(i), str(i * 2), "some text of a cell") for i in range(n)])
        tracemalloc.start()
        seen = sum(1 for _ in R.sheet_rows(data))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen == n + 1
        return most
    assert peak(100_000) < 2 * peak(20_000) + (1 << 20)


def test_a_sheet_is_read_without_a_tree(monkeypatch):
    """Only the small parts become element trees; cells are read as before, whatever their place, type and nesting."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = ['<x:c r="B1" t="s"><x:v>0</x:v></x:c><x:c t="inlineStr"><x:is><x:r><x:t>a &amp; </x:t></x:r><x:r><x:t>b</x:t></x:r></x:is></x:c>',
             '<x:c r="AA2"><x:f>1+1</x:f><x:v>2</x:v><x:v>9</x:v></x:c><x:c r="A2" t="b"><x:v>1</x:v></x:c><x:c r="B2"><x:v/></x:c>',
             "", '<x:c r="A4" t="str"><x:v> té </x:v><x:ext><x:v>no</x:v><x:c r="C4"><x:v>no</x:v></x:c></x:ext></x:c><x:c r="B4" t="inlineStr"/>']
    sheet = f'<x:worksheet xmlns:x="{ns}"><x:sheetData>' + "".join(f"<x:row>{c}</x:row>" for c in cells) + "</x:sheetData></x:worksheet>"
    data = io.BytesIO(workbook(["head"], []))
    out = io.BytesIO()
    with zipfile.ZipFile(data) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name.endswith("sheet1.xml") else old.read(name))
    plain, parts = R.ET.iterparse, []
    monkeypatch.setattr(R.ET, "iterparse", lambda f, events: parts.append(f.name) or plain(f, events=events))
    got = list(R.sheet_rows(out.getvalue()))
    assert got == [[None, "a & b"], ["True", *[None] * 25, "2"], [], [" té ", ""]]
    assert parts == ["xl/sharedStrings.xml"]
