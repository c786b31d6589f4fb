"""Token-id output (4): tokenise documents and write Elias-Fano bounded id files in doc_id order.

``write_token_files`` deals documents to shards of consecutive doc_ids (bounds
are quantiles of the ids alone), encodes them in the map stage, shuffles only
id bytes, and each task streams its shards into files under the given folder.
``read_token_files`` reads them back with one row per document.

Defined results: a null text is empty; every document ends with ``end_id``;
rows without a doc_id come first; rows that share a doc_id follow each other by
the CRC of their ids; an empty table writes no file and reads back as no rows;
other columns are not read, whatever their names.

Recovery: a file is written under an attempt's own name and moved to its final
name, which depends on the shard only; a repeated task replaces it by the same
bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import elias_fano as ef
from claimlens.llm.token_ids import encoder

DOCS_PER_SHARD = 4096


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0,
                      docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Write the files; returns one row per shard (shard, n_docs, n_ids), already computed."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = source.count()
    shards = max(1, -(-rows // docs_per_shard))
    cuts = source.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for got in enc.encode(batch.column(1)):
                own = batch.column(0)[got.first:got.first + len(got.bounds) - 1]
                ids = [got.ids[a:b].tobytes() + end for a, b in zip(got.bounds[:-1].tolist(), got.bounds[1:].tolist())]
                shard = np.where(own.is_null(), 0, np.searchsorted(bounds, own.fill_null(0).to_numpy(), side="right"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), own, pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["shard", "doc_id", "crc", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer_path).dtype.itemsize
        rows = ((s, d, x) for b in batches for s, d, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            n_docs, n_ids = _write_shard(folder, shard, own, width)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": n_docs, "n_ids": n_ids}], schema=_SHARD)

    encoded = source.mapInArrow(encode, "shard int, doc_id long, crc long, ids binary")
    dealt = encoded.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc")
    table = dealt.mapInArrow(write, "shard int, n_docs long, n_ids long")
    found = table.collect()  # one small row for each shard, that is for each docs_per_shard documents
    return spark.createDataFrame([tuple(r) for r in found], "shard int, n_docs long, n_ids long")


_SHARD = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _write_shard(folder: str, shard: int, rows, width: int) -> tuple[int, int]:
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(root, recursive=True)
    final, own = f"{root}/shard-{shard:07d}.eft", f"{root}/_part-{shard:07d}-{uuid.uuid4().hex}"
    doc_ids, lengths = [], []

    def blocks():
        for _, doc_id, ids in rows:
            doc_ids.append(doc_id)
            lengths.append(len(ids) // width)
            yield ids

    with system.open_output_stream(own) as out:
        n_ids = ef.write_file(out, blocks(), doc_ids, lengths, width)
    system.move(own, final)
    return len(doc_ids), n_ids


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    base, total = {}, 0
    for r in sorted(shards.collect()):
        base[r["shard"]] = total
        total += r["n_ids"]
    if not base:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                shard = int(path.as_py().rpartition("-")[2].split(".")[0])
                file = ef.TokenFile(content.as_buffer())
                ends = file.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                wide = file.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(starts + base[shard]), pa.array(ends - starts),
                     pa.array(crc, pa.int64()), pa.array([shard] * len(crc), pa.int32())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.eft").load(folder).select("path", "content")
    return files.mapInArrow(parse, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
