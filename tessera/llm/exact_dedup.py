"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stage

#: Bits of the filter per row, and the largest filter that is broadcast (32 MiB).
BITS_PER_ROW = 16
MAX_BROADCAST_BITS = 1 << 28
#: A text with more copies than 1/HOT_SHARE of the candidates is hot: at most HOT_SHARE texts are.
HOT_SHARE = 1000
_SEEDS = (17, 4711)


def _slot(hashed: Column, seed: int, bits: int) -> Column:
    """A place in the filter from a text's hash."""
    return F.pmod(F.xxhash64(F.lit(seed), hashed), F.lit(bits))


def bit_of(bitmap: Column, slot: Column) -> Column:
    """The bit of ``slot`` in a bitmap of 32,768 bits made by bitmap_construct_agg; null is 0."""
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(position, F.lit(8)).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit)), F.lit(2)) == 1, F.lit(False))


def repeated_slots(text_rows: DataFrame, text: str, bits: int) -> DataFrame:
    """Pass 1: the Bloom filter's bitmaps of the texts whose hash two rows or more have; one 64-bit hash a row shuffles, counted before and after."""
    twice = text_rows.groupBy(F.xxhash64(text).alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    slots = twice.select(F.explode(F.array(*[_slot(F.col("h"), s, bits) for s in _SEEDS])).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def _tested(rows: DataFrame, filters: DataFrame, h1: str, h2: str, maybe: str, work: str) -> DataFrame:
    """``rows`` with ``maybe``: both slots (h1, h2, which go) are set in the filter."""
    for slot, end in ((h1, "1"), (h2, "2")):
        side = filters.select(F.col("bucket").alias(work + end), F.col("bitmap").alias(maybe + end))
        rows = rows.join(side, F.bitmap_bucket_number(slot) == F.col(work + end), "left").withColumn(maybe + end, bit_of(F.col(maybe + end), F.col(slot)))
    return rows.withColumn(maybe, F.col(maybe + "1") & F.col(maybe + "2")).drop(*[x + end for x in (work, maybe) for end in "12"], h1, h2)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Pass 1 counts rows by one 64-bit hash of the text (of each row no more than that hash shuffles) and marks the two Bloom slots of
    each hash met more than once in bitmaps. Pass 2 tests each row against them: a row without both of its slots set
    is unique and passes straight through; only the rest shuffle, as (id, SHA-256), and are
    grouped exactly. The bitmaps are broadcast up to 32 MiB. A larger filter tests (id, SHA-256, slots) by bucket, and the
    few groups that come of it are joined to the rows, which then move once; the result is the same.
    Texts with very many copies (at most 1,000 of them) are joined by broadcast, so no key is hot.

    A null text counts as empty. A null id is less than any other; a group with null ids alone has a null
    ``keep_id`` and keeps all its rows. Rows that tie on text and largest id are all kept. An empty table
    gives an empty table. Other columns are carried along; the four result columns replace any of the same name.
    """
    sha, h1, h2, maybe, top, size = free_names(docs, ["text_sha", "slot_a", "slot_b", "maybe_repeated", "top_id", "copies"])
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = docs.count()
    bits = 1 << 20
    while bits < BITS_PER_ROW * n:
        bits *= 2
    filters = stage(repeated_slots(rows, "t", bits), "bloom")

    text = F.coalesce(F.col(text_col), F.lit(""))
    slots = {h1: _slot(F.xxhash64(text), _SEEDS[0], bits), h2: _slot(F.xxhash64(text), _SEEDS[1], bits)}
    hashed = docs.withColumn(sha, F.sha2(text, 256))
    if bits <= MAX_BROADCAST_BITS:
        probed = _tested(hashed.withColumns(slots), F.broadcast(filters), h1, h2, maybe, top)
        candidates = probed.filter(F.col(maybe))
    else:
        probed = hashed.withColumn(maybe, F.lit(True))
        narrow = hashed.withColumns(slots).select(id_col, sha, h1, h2)
        candidates = _tested(narrow, filters, h1, h2, maybe, top).filter(F.col(maybe))
    groups = stage(
        candidates.groupBy(sha).agg(F.max(id_col).alias(top), F.count("*").alias(size)).filter(F.col(size) > 1), "copies"
    )
    hot_from = max(2, n // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > hot_from))
    known = probed.join(hot, sha, "left")
    settled = known.filter(~F.col(maybe) | F.col(size).isNotNull())
    open_rows = known.filter(F.col(maybe) & F.col(size).isNull()).drop(top, size)
    cold = groups.filter(F.col(size) <= hot_from)
    joined = settled.unionByName(open_rows.join(cold, sha, "left"))
    return joined.withColumns({
        "keep_id": F.when(F.col(size).isNull(), F.col(id_col)).otherwise(F.col(top)),
        "group_size": F.coalesce(F.col(size), F.lit(1)).cast("long"),
        "text_sha256": F.col(sha),
    }).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).drop(*{sha, maybe, top, size} - {"text_sha256"})


def query(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
