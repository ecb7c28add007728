"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, shared_dir, stage
from .pretoken import library_encoder

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Tokens after which a block of documents is closed.
BLOCK_TOKENS = 1 << 18
_BLOCK = "part int, block int, start long, n_tokens long, doc_ids binary, lengths binary, control binary, data binary"
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its bytes less one, lowest first) and the values' bytes, lowest first."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    every = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), every[np.arange(4) < size[:, None]].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values: lengths by table lookup of the control bytes, then the bytes by place."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size)
    starts = ends - size
    source = np.frombuffer(data, np.uint8)
    out = source[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= source[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class TokenFiles:
    """``path``/blocks: one row a block of documents; ``path``/ranks: the id of each frequency rank."""

    path: str


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian), with the end id after each document.

    An id takes two bytes, or four where the vocabulary has more than 65,536. A null or empty text gives the end id alone, an empty table no rows; null ids and
    repeated rows are documents like any other.
    """

    def make():
        encoder = library_encoder(vocabulary)
        end = np.asarray([END], encoder.kind).tobytes()
        return lambda texts: [[x + end for x in encoder.encode(texts)]]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return map_text(rows, "t", {"ids": "binary"}, make).drop("t")


def _values(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All ids of a column of documents' ids in a row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (offsets[-1] - offsets[0]) // kind.itemsize, offsets[0]) if len(column) else np.empty(0, kind)


def _counts(kind: np.dtype):
    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            new = np.bincount(_values(batch.column(0), kind), minlength=len(total))
            new[: len(total)] += total
            total = new
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return counts


def write_token_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all documents and write them in ascending id order; Spark commits the files, so lost tasks do no harm.

    Ids are ranked by their count over all documents (a table bounded by the vocabulary). A null text counts as
    empty, null ids come first, rows with one id follow by content. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    kind = library_encoder(vocabulary).kind
    encoded = stage(encode_documents(docs, vocabulary, id_col, text_col), "token-ids", "zstd")
    counts = encoded.select("ids").mapInArrow(_counts(kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(np.asarray(ranked, "<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/ranks")
    rank = np.zeros(1 + max(ranked, default=0), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def blocks(batches):
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids, held, size = [], [], 0

        def close():
            control, data = pack_values(rank[np.concatenate(held)])
            lengths = np.asarray([len(x) for x in held], "<u4").tobytes()
            keys = pa.array(ids, pa.int64())
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([keys], ["doc_id"]))
                key_bytes = sink.getvalue().to_pybytes()
            row = [part, number, start, size, key_bytes, lengths, control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                held.append(np.frombuffer(value.as_buffer(), kind).copy())
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield close()
                    start, number, ids, held, size = start + size, number + 1, [], [], 0
        if held:
            yield close()

    parts = max(1, encoded.rdd.getNumPartitions())
    ordered = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, _BLOCK).write.parquet(f"{path}/blocks")
    return TokenFiles(path)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (binary, four little-endian bytes an id)."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{files.path}/blocks")
    ranks = np.frombuffer(spark.read.parquet(f"{files.path}/ranks").first()["ids"], "<u4")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(totals):
        base[part] = before
        before += totals[part]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = ranks[unpack_values(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                keys = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
                starts = ends - lengths + base[row["part"]] + row["start"]
                values = [ids[a - n : a].tobytes() for a, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(lengths), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir, vocabulary: str | None = None):
    from .common import documents

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(documents(spark, sf_dir).select("doc_id", "text"), vocabulary or public_tokenizers.path(VOCABULARY), path)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
