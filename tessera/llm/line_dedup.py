"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches, stage
from .cuckoo import CuckooFilter
from .exact_dedup import bit_of

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys that a shard's filter is meant to hold, and the largest sum of filters that is broadcast.
SHARD_KEYS = 100_000
MAX_FILTER_BYTES = 32 << 20
#: Keys held by more than 1/HOT_SHARE of all postings are joined by broadcast: at most HOT_SHARE keys.
HOT_SHARE = 5_000
#: Bits of the bitmap of documents that lose lines, per document, and the largest bitmap that is broadcast (32 MiB).
BITS_PER_ID, MAX_ID_BITS = 16, 1 << 28
NO_ID = -(2**63)
_SPACE = b" \t\n\v\f\r"
_KEY = ["key_hi", "key_lo"]
_POSTING = "key_hi long, key_lo long, doc long"
#: Tasks that share the lines of one shard where filters are not broadcast.
SALTS = 8


@dataclass(frozen=True)
class LineIndex:
    """``postings`` (key, doc) is the exact ground; ``counts`` (key, n_docs, max_doc) and ``filters`` follow it."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def line_keys(text: bytes) -> tuple[list[bytes], np.ndarray, list[int]]:
    """The lines of a text, the 128-bit keys of those long enough (k x 2, int64), and their places."""
    lines = text.split(b"\n")
    digests, places = [], []
    for i, line in enumerate(lines):
        if len(line) >= MIN_CHARS:
            key = line.strip(_SPACE).lower()
            if len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "replace")) >= MIN_CHARS:
                digests.append(xxhash.xxh3_128_digest(key))
                places.append(i)
    return lines, np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64), places


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("t").cast(pa.binary()).to_pylist()]


def _postings(batches):
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("d").to_pylist(), _texts(batch), strict=True):
            found = np.unique(line_keys(text)[1], axis=0)
            keys.append(found)
            ids.append(np.full(len(found), doc, np.int64))
        if keys:
            both = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(ids))], [*_KEY, "doc"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )


def _new_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stage(_rows(docs, id_col, text_col).mapInArrow(_postings, _POSTING), "postings")


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


def _updated_filters(filters: DataFrame | None, counts: DataFrame, changes: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Apply inserts (+1) and deletes (-1) of keys to each shard's filter; a full filter is built anew from the counts."""
    shard = F.pmod(F.col("key_hi"), F.lit(shards)).cast("int").alias("shard")
    parts = counts.filter(F.col("n_docs") >= min_docs).select(shard, F.col("key_lo"), F.lit(0).alias("change"), F.lit(None).cast("binary").alias("filter"))
    parts = parts.unionByName(changes.select(shard, "key_lo", "change", F.lit(None).cast("binary").alias("filter")))
    if filters is not None:
        parts = parts.unionByName(filters.select("shard", F.lit(0).cast("long").alias("key_lo"), F.lit(2).alias("change"), "filter"))

    def update(part: pd.DataFrame) -> pd.DataFrame:
        keys = {c: part.key_lo[part.change == c].to_numpy(np.int64).view(np.uint64) for c in (-1, 0, 1)}
        old = part["filter"][part.change == 2]
        now = CuckooFilter.from_bytes(old.iloc[0]) if len(old) else None
        if now is not None:
            now.delete(keys[-1])
        if now is None or not now.insert(keys[1]):
            capacity = max(64, 2 * len(keys[0]))
            while not (now := CuckooFilter(capacity)).insert(keys[0]):
                capacity *= 2
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "filter": [now.to_bytes()]})

    return stage(parts.groupBy("shard").applyInPandas(update, "shard int, filter binary"), "line-filters")


def _shards(repeated: DataFrame) -> int:
    return max(4, -(-repeated.count() // SHARD_KEYS))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> LineIndex:
    """Index the lines of ``docs``; each row is a document."""
    postings = _new_postings(docs, id_col, text_col)
    counts = stage(_count(postings), "line-counts")
    repeated = counts.filter(F.col("n_docs") >= min_docs)
    shards = _shards(repeated)
    filters = _updated_filters(None, counts, repeated.select(*_KEY, F.lit(1).alias("change")).limit(0), shards, min_docs)
    return LineIndex(postings, counts, filters, shards, min_docs)


def _moved(index: LineIndex, touched: DataFrame, counts: DataFrame) -> DataFrame:
    """Keys that crossed the threshold: +1 upward, -1 downward."""
    was = index.counts.select(*_KEY, F.col("n_docs").alias("was"))
    now = counts.select(*_KEY, F.col("n_docs").alias("now"))
    both = touched.join(was, _KEY, "left").join(now, _KEY, "left").fillna(0, ["was", "now"])
    m = index.min_docs
    change = F.when((F.col("was") < m) & (F.col("now") >= m), 1).when((F.col("was") >= m) & (F.col("now") < m), -1)
    return both.select(*_KEY, change.alias("change")).filter("change is not null")


def add_documents(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with ``docs`` added; only their keys are counted and only changed shards gain fingerprints.

    An id that the index has already is the same document once more: its old lines go first, so adding twice
    counts once. The filters are dealt anew when the repeated keys are four times what the shards are meant for.
    """
    known = index.postings.select("doc").distinct().join(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")).filter(F.col("doc") != NO_ID).distinct(), "doc", "left_semi")
    known = stage(known, "line-known")
    if known.head(1):
        index = remove_documents(index, known)
    new = _new_postings(docs, id_col, text_col)
    counts = stage(
        index.counts.unionByName(_count(new)).groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")),
        "line-counts",
    )
    repeated = counts.filter(F.col("n_docs") >= index.min_docs)
    shards = _shards(repeated)
    if shards > 4 * index.shards:
        filters, shards = _updated_filters(None, counts, repeated.select(*_KEY, F.lit(1).alias("change")).limit(0), shards, index.min_docs), shards
    else:
        filters, shards = _updated_filters(index.filters, counts, _moved(index, new.select(*_KEY).distinct(), counts), index.shards, index.min_docs), index.shards
    return LineIndex(index.postings.unionByName(new), counts, filters, shards, index.min_docs)


def remove_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents whose ids ``ids`` (one column) has, as if they had never been added."""
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("doc")).distinct()
    live = index.postings.join(gone, "doc", "left_anti")
    touched = stage(index.postings.join(gone, "doc", "left_semi").select(*_KEY).distinct(), "line-touched")
    again = _count(live.join(touched, _KEY, "left_semi").select(*_KEY, "doc"))
    counts = stage(index.counts.join(touched, _KEY, "left_anti").unionByName(again), "line-counts")
    filters = _updated_filters(index.filters, counts, _moved(index, touched, counts), index.shards, index.min_docs)
    return LineIndex(live.select(*_KEY, "doc"), counts, filters, index.shards, index.min_docs)


def _probe_all(index: LineIndex, posted: DataFrame) -> DataFrame:
    """Those of ``posted`` (key, doc) that a filter knows; all filters are sent to every task."""
    shards = index.shards
    sent = posted.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in index.filters.collect()})

    def probe(batches):
        filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy() for c in _KEY)
            shard, hit = np.mod(hi, shards), np.zeros(len(hi), bool)
            for k, one in filters.items():
                mine = np.flatnonzero(shard == k)
                hit[mine] = one.contains(lo[mine].view(np.uint64))
            yield batch.filter(pa.array(hit))

    return posted.select(*_KEY, "doc").mapInArrow(probe, _POSTING)


def _probe_by_shard(index: LineIndex, posted: DataFrame) -> DataFrame:
    """The same, where the filters are too large together: lines go to their shard's filter, dealt to SALTS tasks a shard.

    A task reads one filter at a time, ahead of the lines that it tests.
    """
    salt = F.pmod(F.xxhash64("key_lo"), F.lit(SALTS)).cast("int")
    lines = posted.select(F.pmod("key_hi", F.lit(index.shards)).cast("int").alias("shard"), salt.alias("salt"), F.lit(1).alias("side"), *_KEY, "doc", F.lit(None).cast("binary").alias("filter"))
    nothing = [F.lit(0).cast("long").alias(c) for c in (*_KEY, "doc")]
    filters = index.filters.select("shard", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"), F.lit(0).alias("side"), *nothing, "filter")
    dealt = lines.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side")

    def probe(batches):
        now, of = None, None
        for batch in batches:
            shard, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            for a, b in _runs(2 * shard.astype(np.int64) + side):
                if side[a] == 0:
                    now, of = CuckooFilter.from_bytes(batch.column("filter")[a].as_py()), shard[a]
                elif of == shard[a]:
                    part = batch.slice(a, b - a)
                    hit = now.contains(part.column("key_lo").to_numpy().view(np.uint64))
                    yield part.select([*_KEY, "doc"]).filter(pa.array(hit))

    return dealt.mapInArrow(probe, _POSTING)


def _runs(values: np.ndarray):
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True) if len(values) else ()


def _candidates(index: LineIndex, posted: DataFrame) -> DataFrame:
    size = index.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    return _probe_all(index, posted) if size <= MAX_FILTER_BYTES else _probe_by_shard(index, posted)


def _dropped(index: LineIndex, posted: DataFrame) -> DataFrame:
    """For each document of ``posted`` (key, doc) the keys whose lines it loses: (d, keys)."""
    repeated = index.counts.filter(F.col("n_docs") >= index.min_docs).select(*_KEY, "n_docs", "max_doc")
    hot_from = max(index.min_docs, index.postings.count() // HOT_SHARE)
    found = _candidates(index, posted)
    found = found.join(F.broadcast(repeated.filter(F.col("n_docs") > hot_from).select(*_KEY, F.col("max_doc").alias("hot_doc"))), _KEY, "left")
    found = stage(found, "line-candidates")
    hot = found.filter(F.col("hot_doc").isNotNull()).select(*_KEY, "doc", F.col("hot_doc").alias("max_doc"))
    cold = found.filter(F.col("hot_doc").isNull()).select(*_KEY, "doc").join(
        repeated.filter(F.col("n_docs") <= hot_from).select(*_KEY, "max_doc"), _KEY)
    lost = hot.unionByName(cold).filter(F.col("doc") != F.col("max_doc"))
    return lost.groupBy(F.col("doc").alias("d")).agg(F.collect_set(F.struct(*_KEY)).alias("keys"))


def _touched(docs: DataFrame, lost: DataFrame, doc: str, maybe: str) -> DataFrame:
    """``docs`` with ``maybe``: whether ``doc`` may lose lines, by a bitmap of the hashed ids in ``lost`` that is sent to every task.

    Up to MAX_ID_BITS of the bitmap a row knows where it stands without a shuffle; beyond, all rows may lose lines.
    """
    n, bits = lost.count(), 1 << 20
    while bits < BITS_PER_ID * n:
        bits *= 2
    if bits > MAX_ID_BITS:
        return docs.withColumn(maybe, F.lit(True))
    slot = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(bits))
    place, bucket, bitmap = free_names(docs, ["line_slot", "line_bucket", "line_bits"])
    marks = lost.select(slot("d").alias(place)).groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    tested = docs.withColumn(place, slot(F.col(doc))).join(F.broadcast(marks), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    return tested.withColumn(maybe, bit_of(F.col(bitmap), F.col(place))).drop(place, bucket, bitmap)


def apply_index(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_dropped``.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least 20 code
    points found in at least ``min_docs`` documents lose all their lines but those of the largest id.
    Filter hits are verified in the exact table before a line goes. Only documents that lose lines are shuffled with their texts; the others go
    straight through. Each row is a document; a null text is one empty line; a null id is less than any other. Documents that lose nothing keep their text as it
    is. Staged tables stay until ``common.drop_staged``.
    """
    return _applied(index, docs, id_col, text_col, _rows(docs, id_col, text_col).mapInArrow(_postings, _POSTING))


def _applied(index: LineIndex, docs: DataFrame, id_col: str, text_col: str, posted: DataFrame) -> DataFrame:
    """``apply_index`` where the documents' keys are known: ``posted`` (key, doc)."""
    doc, keys, text, maybe = free_names(docs, ["line_doc", "line_keys", "line_text", "line_maybe"])
    lost = stage(_dropped(index, posted), "line-lost")
    named = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text: F.coalesce(F.col(text_col), F.lit(""))})
    marked = _touched(named, lost, doc, maybe)
    moved = marked.filter(F.col(maybe)).join(lost.select(F.col("d").alias(doc), F.col("keys").alias(keys)), doc, "left")
    joined = moved.unionByName(marked.filter(~F.col(maybe)).withColumn(keys, F.lit(None).cast(lost.schema["keys"].dataType)))
    own = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    plain = joined.select(*own, text, keys)
    schema = plain.select(*own).schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    width = len(own)

    def rewrite(batches):
        for batch in batches:
            kept, counts, drops = [], [], []
            for value, gone in zip(batch.column(width).cast(pa.binary()).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                if not gone:
                    kept.append(value)
                    counts.append(value.count(b"\n") + 1)
                    drops.append(0)
                    continue
                lines, found, places = line_keys(value)
                gone = {(x["key_hi"], x["key_lo"]) for x in gone}
                out = {p for p, k in zip(places, map(tuple, found.tolist()), strict=True) if k in gone}
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in out]))
                counts.append(len(lines))
                drops.append(len(out))
            arrays = [batch.column(i) for i in range(width)]
            arrays += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "kept_text", "n_lines", "n_dropped"])

    return plain.mapInArrow(rewrite, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` and apply the index to them."""
    index = build_index(docs, id_col, text_col)
    return _applied(index, docs, id_col, text_col, index.postings)  # the postings hold these documents' keys already


def query(spark, sf_dir):
    from .common import documents

    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
counts AS (
  SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k),
marked AS (
  SELECT keyed.doc_id, keyed.pos, keyed.line, coalesce(c.n >= 3 AND keyed.doc_id <> c.top, false) AS gone
  FROM keyed LEFT JOIN counts c ON keyed.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
