"""SimHash near-dedup: an inverted index of byte positions, count filtering, verification, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, small_batches, stage
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BYTES = 8
#: Fingerprints that differ in MAX_BITS bits at most share at least this many of their bytes, each at its place.
LEAST_SHARED = BYTES - MAX_BITS
#: Any LEAST_SHARED of the eight places hold one of these threes: three places of one half of the fingerprint.
THREES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
#: The longest list of fingerprints that is compared by threes; longer ones are looked up by five places.
MAX_LIST = 2048
#: A fingerprint, or the first two bytes of a three, is hot with more than 1/HOT_SHARE of the rows: at most HOT_SHARE are.
HOT_SHARE = 1000
_CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """Bit b is set where over half the shingles' hashes have it; no words: zero."""
    words = text.encode().lower().split()  # bytes: A-Z alone, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(SHINGLE, len(words))
    starts, stops = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        some = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in some], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints():
    def run(texts):
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return run


def _byte(f, place: int):
    return F.shiftrightunsigned(f, 8 * place).bitwiseAND(F.lit(255))


def _key(f, places) -> "F.Column":
    """The bytes of ``f`` at ``places``, one beside the other."""
    key = F.lit(0).cast("long")
    for k, place in enumerate(places):
        key = key.bitwiseOR(F.shiftleft(_byte(f, place), 8 * k))
    return key


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` (rows) and ``b`` (columns) are near: the shared bytes are tallied first, and only pairs with LEAST_SHARED are verified bit by bit."""
    differ = a[:, None] ^ b[None, :]
    shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8) >= LEAST_SHARED
    near = np.zeros(differ.shape, bool)
    near[shared] = np.bitwise_count(differ[shared]) <= MAX_BITS
    return near


def forest(list_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked in a list, each fingerprint to one that was met before: breadth first, only those not yet met are compared."""
    out, left = [], list_
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            new = []
            for at in range(0, len(left), 4096):
                near = linked(some, left[at : at + 4096])
                hit = near.any(axis=0)
                out.append((some[near[:, hit].argmax(axis=0)], left[at : at + 4096][hit]))
                new.append(hit)
            hit = np.concatenate(new)
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (list_[:0], list_[:0])


def dense_forest(list_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a long list whose rows share five bytes: each row looks for its 2,324 neighbours in the other three bytes, so the cost is linear."""
    list_ = np.sort(list_)
    open_bits = [b for b in range(64) if len(np.unique((list_ >> np.uint64(8 * (b // 8))) & np.uint64(255))) > 1]
    label = np.arange(len(list_))
    for size in range(1, MAX_BITS + 1):
        for bits in combinations(open_bits, size):
            other = list_ ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(list_, other), len(list_) - 1)
            one = np.flatnonzero((list_[at] == other) & (list_ < other))
            while len(one := one[(x := label[one]) != (y := label[at[one]])]):
                x, y = label[one], label[at[one]]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != (up := label[label])).any():
                    label = up
    rest = np.flatnonzero(label != np.arange(len(list_)))
    return list_[label[rest]], list_[rest]


def _lists(most: int | None):
    """Rows (place, key, f) sorted by list: edges within each list as (kind 0, a, b); of lists longer than ``most``, each row as (kind 1, f, place).

    Lists of two are compared all at once; no list is held beyond ``most`` rows. Without ``most``, lists share five bytes and have at most 2^24 rows.
    """

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def flush(place, values):
        if most and len(values) > most:
            yield out(1, values, np.full(len(values), place, np.int64))
        elif len(values) > 1:
            a, b = forest(values) if len(values) <= 2 * MAX_LIST else dense_forest(values)
            if len(a):
                yield out(0, a, b)

    def run(batches):
        at, held, n, spilled = None, [], 0, False
        for batch in batches:
            place, key, f = (batch.column(c).to_numpy() for c in ("place", "key", "f"))
            f = f.view(np.uint64)
            cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(key) != 0)) + 1
            begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(f)]])
            if not len(f):
                continue
            whole = np.zeros(len(begins), bool)  # lists of one or two that begin and end in this batch
            whole[1:-1] = (ends - begins)[1:-1] <= 2
            pairs = begins[whole & (ends - begins == 2)]
            if len(pairs):
                near = np.array([linked(f[i : i + 1], f[i + 1 : i + 2])[0, 0] for i in pairs]) if len(pairs) < 32 else _near(f[pairs], f[pairs + 1])
                if near.any():
                    yield out(0, f[pairs][near], f[pairs + 1][near])
            for a, b in zip(begins[~whole].tolist(), ends[~whole].tolist(), strict=True):
                name = (place[a], key[a])
                if name != at:
                    if held:
                        yield from flush(at[0], np.concatenate(held))
                    at, held, n, spilled = name, [], 0, False
                held.append(f[a:b])
                n += b - a
                if most and (spilled or n > most):
                    values, held, spilled = np.concatenate(held), [], True
                    yield out(1, values, np.full(len(values), at[0], np.int64))
        if held:
            yield from flush(at[0], np.concatenate(held))

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``linked`` of a[i] and b[i]."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= LEAST_SHARED
    return shared & (np.bitwise_count(differ) <= MAX_BITS)


_EDGES = "kind int, a long, b long"


def near_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``f`` of ``prints`` just as all links would.

    The index lists fingerprints by three places of one half and their bytes; any two that share five bytes meet in at least one of
    eight lists. Within a list shared bytes are tallied a pair, pairs with five are verified, and a forest goes on instead of all
    links. Lists that are too long, which 2^19 counts by the first two of the bytes tell before anything is dealt, are looked up by
    five places instead: the two more that a pair must share besides a three. These share 40 bits, so none has more than 2^24 rows.
    """
    places = F.array(*[F.struct(F.lit(i).alias("place"), _key("f", p).alias("key")) for i, p in enumerate(THREES)])
    posted = prints.select("f", F.explode(places).alias("p")).select("p.place", "p.key", "f")
    head = F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("head")
    total = prints.count()
    hot = posted.groupBy("place", head).agg(F.count("*").alias("n")).filter(F.col("n") > max(MAX_LIST, len(THREES) * total // HOT_SHARE)).select("place", "head")
    hot = F.broadcast(stage(hot, "hot-bytes"))
    marked = posted.withColumn("head", head).join(hot.withColumn("hot", F.lit(True)), ["place", "head"], "left")
    dealt = marked.filter("hot is null").select("place", "key", "f").repartition("place", "key").sortWithinPartitions("place", "key", "f")
    first = stage(dealt.mapInArrow(_lists(MAX_LIST), _EDGES), "near-edges")
    longer = first.filter("kind = 1").select(F.col("a").alias("f"), F.col("b").alias("place")).unionByName(marked.filter("hot").select("f", F.col("place").cast("long").alias("place")))
    fives = []
    for i, three in enumerate(THREES):
        for more in combinations([p for p in range(BYTES) if p not in three], LEAST_SHARED - len(three)):
            five = sorted({*three, *more})
            fives.append(F.when(F.col("place") == i, F.struct(F.lit(sum(1 << p for p in five)).alias("place"), _key("f", five).alias("key"))))
    again = longer.select("f", F.explode(F.filter(F.array(*fives), lambda x: x.isNotNull())).alias("p")).select("p.place", "p.key", "f").distinct()
    second = again.repartition("place", "key").sortWithinPartitions("place", "key", "f").mapInArrow(_lists(None), _EDGES)
    return first.filter("kind = 0").select("a", "b").unionByName(second.select("a", "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (smallest id reachable by links) for each row of ``docs``.

    Words are maximal runs of other than ASCII white space, A-Z lower-cased; shingles are three words, repeats
    included, or the whole sequence where there are fewer. Rows of one fingerprint are one node; nodes link at MAX_BITS or fewer
    differing bits.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. A null id takes part in links but
    names no component, unless all of its component are null (then null). Repeated rows are rows of their own. An empty table gives no rows. Extra
    columns are not read. Fingerprints, edges and components are written tables that stay until ``common.drop_staged``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    marked = stage(map_text(rows, "t", {"f": "long"}, _fingerprints).select("doc_id", "f"), "fingerprints")
    nodes = stage(marked.groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    comps = connected_components(near_edges(nodes.select("f")))
    placed = stage(nodes.join(comps, nodes.f == comps.node, "left").select("f", "first", "n", F.coalesce("comp", "f").alias("comp")), "placed")
    heads = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = placed.join(heads, "comp").select("f", "n", "component_id")
    hot_from = max(1, marked.count() // HOT_SHARE)
    hot = F.broadcast(named.filter(F.col("n") > hot_from).select("f", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    both = marked.join(hot, "f", "left")
    cold = both.filter("hot is null").select("doc_id", "f").join(named.filter(F.col("n") <= hot_from), "f").select("doc_id", "f", "component_id")
    out = both.filter("hot").select("doc_id", "f", F.col("hot_id").alias("component_id")).unionByName(cold)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    from .common import documents

    return simhash_components(documents(spark, sf_dir).select("doc_id", "text"))
