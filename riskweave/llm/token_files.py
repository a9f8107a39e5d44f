"""Token-id files: Parquet with one list of ids per document.

Rows lie in ascending doc_id order over the files (file names sort as the id
ranges do). Row groups have a bounded size, pages a bounded row count, and the
writer leaves column and offset indexes, so a reader that asks for a few ids or
only for the metadata columns reads only their pages. ``encoding`` chooses
dictionary pages for the ids or delta-packed integers.

Columns: doc_id, part (file order), offset (ids before it in its part),
n_tokens (with the end id), ids (array of int).

Defined results: a null text is empty and holds the end id alone; null doc_ids
come first; rows that share an id stand next to each other, ordered by text;
an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import scattered
from riskweave.llm.pieces import library_ids

END_ID = 2
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                       T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
CHUNK = 1 << 20                          # ids in one Arrow batch, one document at least


def encode_sorted(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows (doc_id, text, part), sorted within their partition, as rows of SCHEMA."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = library_ids(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        part, offset, held, size = None, 0, [], 0

        def batch():
            ids = np.frombuffer(b"".join(h[4] for h in held), dtype="<i4")
            ends = np.concatenate([[0], np.cumsum([h[3] for h in held])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, type=pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([h[j] for h in held], type=t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                + [lists], names=SCHEMA.names)

        for b in batches:
            for i, text, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if p != part:
                    part, offset = p, 0
                ids = b"".join(cache.each(cache.split.findall(text.as_py() or ""))) + end
                held.append((i, p, offset, len(ids) // 4, ids))
                offset += len(ids) // 4
                size += len(ids) // 4
                if size >= CHUNK:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()
    return rows.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID,
                 encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2_000) -> None:
    """Encode every text and write the files. Texts are shuffled once, into id ranges."""
    n = scattered(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = (rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
                .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
                .select("doc_id", "text", F.spark_partition_id().alias("part")))
    out = encode_sorted(rows, vocabulary, end_id).write
    for k, v in {"parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows,
                 "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false",
                 "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
                 "compression": "zstd"}.items():
        out = out.option(k, v)
    out.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; ask for columns and ids with select and where."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, before): ids in all parts before each, from the metadata columns. One row per file."""
    per = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("before"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, part, offset, n_tokens, ids_crc32): crc32 of each list as little-endian uint32."""
    schema = "doc_id bigint, part int, offset bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[4 * x:4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            n = pa.array(np.diff(at), type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), n, pa.array(crc, type=pa.int64())],
                names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])
    return files.select("doc_id", "part", "offset", "ids").mapInArrow(run, schema)


def index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    before = starts(files)                                   # a row per file: its number is the writer's task count
    return (checksums(files).join(F.broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
