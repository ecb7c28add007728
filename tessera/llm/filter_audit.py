"""Filter interaction audit: what each of five filters removes alone, after others, and over all orders."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stage

#: The filters: A few words, B few distinct words, C many capitals, D signs of markup, E an earlier equal text.
LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_SPACE = r"[\x20\x09-\x0D]+"
_KINDS = 1 << len(LETTERS)
#: A null id is less than any other.
_NO_ID = -(2**63)


def word_stats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``words`` and ``distinct_words`` of rows that have words: exploded, counted by (key, word), then by key.

    Rows are dealt by ``key`` before their words are exploded, so both counts find their rows together and a text moves
    once instead of each of its words.
    """
    words = rows.select(key, text).repartition(F.col(key)).select(key, F.explode(F.split(text, _SPACE)).alias("word"))
    each = words.filter("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def _label(labels: DataFrame | None, doc: str, flags: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic``: whether any label of the row's id says 1. Rows without an id are dealt by their key."""
    if labels is None:
        return flags.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(doc)).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col(doc).isNull(), F.pmod(F.xxhash64("key"), F.lit(1000))).otherwise(0)
    both = flags.withColumn("spread", spread).join(one.withColumn("spread", F.lit(0).cast("long")), [doc, "spread"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("spread")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", labels: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """A row a document: ``key``, ``id``, ``part``, ``sha`` of the text, ``abcd`` (bits of the filters A to D that it fails), ``good``, ``toxic``;
    and whether the ids are unique.

    Where ids are null or repeat, rows get numbers of their own in a written table; else the id is the key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if unique := n == ids:
        rows = rows.withColumn("key", F.col("id"))
    else:
        rows = stage(rows.withColumn("key", F.monotonically_increasing_id()), "numbered")
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.length("text")
    marked = F.col("text").rlike("[#$%&*|]")
    flags = rows.select("key", "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), (F.when(capitals, BIT["C"]).otherwise(0) + F.when(marked, BIT["D"]).otherwise(0)).alias("cd"))
    both = flags.join(word_stats(rows, "key", "text"), "key", "left").fillna(0, ["words", "distinct_words"])
    few = F.when(F.col("words") < MIN_WORDS, BIT["A"]).otherwise(0)
    poor = F.when(100 * F.col("distinct_words") < MIN_DISTINCT * F.col("words"), BIT["B"]).otherwise(0)
    return _label(labels, "id", both.withColumn("abcd", few + poor + F.col("cd"))).select("key", "id", "part", "sha", "abcd", "good", "toxic"), unique


def _pattern_counts(rows: DataFrame, unique: bool) -> DataFrame:
    """For each ``part`` the 32 counts of documents by the filters that they fail, of all (n_), good (g_) and toxic (t_) ones.

    Equal texts of one part fail the same of A to D, so they are counted before they meet: a text with very many copies
    is a few rows by then, and the least id among them tells which copies E leaves.
    """
    kind = ["sha", "part", "abcd", "good", "toxic"]
    ids = rows.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    if unique:
        met = ids.groupBy(*kind).agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("at_least", F.lit(1).cast("long"))
    else:
        met = ids.groupBy(*kind, "id").agg(F.count("*").alias("n")).groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("sha")), F.col("at_least")).otherwise(0)
    split = met.withColumn("first", first).withColumn("again", F.col("n") - F.col("first"))
    counts = []
    for name, which in (("n", F.lit(True)), ("g", F.col("good")), ("t", F.col("toxic"))):
        for p in range(_KINDS):
            value = F.col("again" if p & BIT["E"] else "first")
            counts.append(F.sum(F.when(which & (F.col("abcd") == (p & ~BIT["E"])), value).otherwise(0)).alias(f"{name}_{p}"))
    return split.groupBy("part").agg(*counts)


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + c
    return total


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per ``part``, ``filter_order`` (all 120) and ``step`` (1 to 5): ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    A document fails A with under 50 words, B when distinct words are under 65 % of its words, C when over 5 % of its
    code points are A-Z, D when it holds one of ``#$%&*|``, E when a smaller id has the same text. Words are
    exploded and counted by (document, word), then by document; the flags join by outer join; a part is then 32 conditional
    counts (and as many of good and of toxic documents), from which every order follows without another look at the rows.

    Null and empty texts have no words: they fail A, and E but for the smallest id. A null part is the empty string. A null id is less than any
    other; rows with one text and the smallest id all pass E. Repeated rows count each. A document is good or toxic when any label of its id
    says so; rows without an id or a label are neither. An empty table gives no rows. Only the columns named are read.
    """
    rows, unique = failures(docs, id_col, text_col, part_col, labels)
    counted = _pattern_counts(rows, unique)
    after = lambda kind: F.array(*[_sum([F.col(f"{kind}_{p}") for p in range(_KINDS) if not p & m]) for m in range(_KINDS)])
    orders = len(list(permutations(LETTERS)))
    share = [_sum([F.col(f"n_{p}") * (orders // p.bit_count()) for p in range(_KINDS) if p & b]) for b in BIT.values()]
    alone = F.array(*[F.col(f"n_{b}") for b in BIT.values()])
    tables = counted.select("part", after("n").alias("left_n"), after("g").alias("left_g"), after("t").alias("left_t"), alone.alias("alone"), F.array(*share).alias("share"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = tables.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, len(LETTERS) + 1)])))
    mask = lambda upto: sum((F.when(F.instr("filter_order", x) <= upto, b).otherwise(0) for x, b in BIT.items()), F.lit(0))
    at = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord("A")
    b4, now, at_, own = free_names(tables, ["before", "now", "at", "own"])
    steps = steps.withColumns({b4: mask(F.col("step") - 1), now: mask(F.col("step")), at_: at}).withColumn(own, F.expr(f"shiftleft(1, {at_})"))
    lost = lambda kind: F.get(f"left_{kind}", F.col(b4)) - F.get(f"left_{kind}", F.col(now))
    failing = F.get("left_n", F.lit(0)) - F.get("left_n", F.col(own))
    return steps.select(
        "part", "filter_order", "step", F.get("left_n", F.col(now)).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        F.get("alone", F.col(at_)).alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.get("share", F.col(at_)).alias("shapley"),
    )


def query(spark, sf_dir):
    from .common import documents, labels

    return filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id AS id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS bad,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS p
  FROM words LEFT JOIN marks ON doc_id = id),
kinds AS (
  SELECT part, p, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM rows GROUP BY part, p),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE position(l IN o) = 0),
steps AS (
  SELECT o AS filter_order, s::INT AS step, substr(o, s, 1) AS f, 1 << (ascii(substr(o, s, 1)) - 65) AS bit,
         list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(o, 1, s - 1), '') IF x <> ''])::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (p & (coalesce(before, 0) | bit) = 0) AS kept,
         sum(n) FILTER (p & coalesce(before, 0) = 0 AND p & bit <> 0) AS removed,
         sum(n) FILTER (p & coalesce(before, 0) <> 0 AND p & bit <> 0) AS redundant,
         sum(n) FILTER (p = bit) AS unique_fails,
         sum(g) FILTER (p & coalesce(before, 0) = 0 AND p & bit <> 0) AS good_lost,
         sum(b) FILTER (p & coalesce(before, 0) = 0 AND p & bit <> 0) AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
