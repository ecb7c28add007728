"""The corpus pipeline: toxicity, quality, line dedup, near duplicates, packing; each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup, ngram_join, packing, quality, toxicity

#: No SQL says what the fitted classifiers, the tokenizer and the packing plan decide.
ORACLE_SQL = None


def _passed(docs: DataFrame, score: Callable[[DataFrame], DataFrame], predicted: int) -> DataFrame:
    """Rows of ``docs`` that a model gives this prediction, columns as they were: own ones named like the model's come back."""
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted", "held_out")]
    aside = dict(zip(clash, common.free_names(docs, [f"own_{c}" for c in clash]), strict=True))
    scored = score(docs.withColumnsRenamed(aside)).filter(F.col("predicted") == predicted)
    return scored.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (1) does not mark; it is fitted on labelled rows of ``docs``.

    Null and empty texts are scored as empty ones, rows with a null id are scored as the others, repeated rows get one
    score. Without labelled rows, or without rows, nothing is marked.
    """
    model = toxicity.train(docs, common.labels(spark, sf_dir))
    return _passed(docs, lambda rows: toxicity.score_toxicity(rows, model), 0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model (7) accepts; it is fitted on labelled rows of ``docs``.

    Null and empty texts are scored as empty ones, a null length has a place of its own. Without rows, none are left;
    without labelled rows there is no model, and all stay.
    """
    model = quality.train(docs, common.labels(spark, sf_dir))
    if not model["w"].any():
        return docs
    return _passed(docs, lambda rows: quality.score_quality(rows, model), 1)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that line dedup (10) takes; ``n_chars`` follows the text.

    Each row is a document; of rows with one id, all count as holders of a line and none of the largest id loses it. A null
    text becomes an empty one.
    """
    aside = dict(zip(clash := [c for c in docs.columns if c.lower() in ("kept_text", "n_lines", "n_dropped")], common.free_names(docs, [f"own_{c}" for c in clash]), strict=True))
    out = line_dedup.line_dedup(docs.withColumnsRenamed(aside))
    out = out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join (4): the one with the smallest id; documents without words stay.

    Where ids are null or repeat, rows get numbers of their own in a written table, and the first row of each
    component stays, so that copies without an id, or with one id, go too.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    own, work = docs, "doc_id"
    if rows != ids:
        (work,) = common.free_names(docs, ["row_number"])
        own = common.stage(docs.withColumn(work, F.monotonically_increasing_id()), "numbered")
    found = ngram_join.ngram_components(own, id_col=work)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(work))
    return own.join(gone, work, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of best-fit packed sequences (8). A null text is one end token; an empty table packs to no rows."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the documents are written and read again, and a stage's own tables and the documents before it go."""
    docs, kept = common.documents(spark, sf_dir), common.staged()
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        *done, last = [path for path in common.staged() if path not in kept]
        common.drop_staged(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
