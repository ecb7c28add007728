"""N-gram Jaccard join: globally ordered shingle sets in a prefix tree, with shared partial overlaps and length bounds."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .components import connected_components
from .words import K1, mix, word_hashes

WORDS = 5
#: Two sets link when 100 * shared >= PERCENT * union.
PERCENT = 75
#: Shingles that a task holds before it hands them on; bytes of text whose shingles one shard holds about.
FLUSH, SHARD_BYTES = 1 << 20, 12 << 20
#: Sets, and shingles, that a prefix tree is meant to hold: larger groups are dealt to several trees.
TREE_SETS, TREE_SHINGLES = 512, 1 << 20
#: Sets that link differ in size by less than this factor, so their bands are the same or neighbours.
BAND = 1.01 * 100 / PERCENT
_SEEDS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5], np.uint64)
_ROW = "shard int, kind int, doc_id long, n int, set_id long, blob binary"
_SET = "kind int, doc_id long, n int, set_id long, m int, mins array<long>, prefix array<long>, tokens binary"


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of all words where there are fewer; A-Z lower-cased."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    size = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        x = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            x = x * K1 + h[k : len(h) - size + 1 + k]
        return np.unique(mix(x + np.uint64(size)))


def _need(n: np.ndarray) -> np.ndarray:
    """Least overlap that a set of ``n`` has with any set it links with."""
    return -(-PERCENT * n // 100)


def _need_both(n, other):
    """Least overlap with which sets of these sizes link."""
    return -(-PERCENT * (n + other) // (100 + PERCENT))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: the upper planes of small numbers and differences cost little."""
    heads, bodies = [len(arrays)], []
    for x in arrays:
        width = x.dtype.itemsize
        bodies.append(pa.compress(x.view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True))
        heads += [width, len(x), len(bodies[-1])]
    return np.array(heads, "<u4").tobytes() + b"".join(bodies)


def _unpack(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, "<u4", 1)[0])
    heads = np.frombuffer(blob, "<u4", 3 * count, 4).reshape(-1, 3).tolist()
    at, out = 4 + 12 * count, []
    for width, many, size in heads:
        planes = pa.decompress(blob[at : at + size], width * many, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, many).T).view(f"<u{width}").ravel())
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; ``np.cumsum`` takes them back."""
    return np.diff(ascending, prepend=np.uint64(0))


def _table(names: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending ``names`` that ``of`` uses, and for each of ``of`` its place among them."""
    used = np.flatnonzero(np.bincount(of, minlength=len(names)))
    place = np.zeros(len(names), np.uint32)
    place[used] = np.arange(len(used))
    return names[used], place[of].astype("<u2" if len(used) <= 1 << 16 else "<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _ROW.split(", ")])


def _runs(sorted_values: np.ndarray):
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)], strict=True) if len(sorted_values) else ()


def _scatter(shards: int):
    """Documents to rows of kind 0 (id, set, size), kind 1 (shingles with their sets, dealt by the shingles' range) and
    kind 2 (sets with their sizes, dealt by set). A set goes once a task."""
    edges = np.array([-(-(i << 64) // shards) for i in range(1, shards)], np.uint64)

    def flush(sets: list[np.ndarray], ids: list[int]):
        names = np.array(ids, np.uint64)
        order = np.argsort(names)
        names, sets = names[order], [sets[i] for i in order.tolist()]
        sizes = np.array([len(x) for x in sets], "<u4")
        home = (names % np.uint64(shards)).astype(np.int64)
        for k in np.unique(home).tolist():
            yield k, 2, None, None, None, _pack(_steps(names[home == k]), sizes[home == k])
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens)
        tokens, of = tokens[order], of[order]
        cuts = [0, *np.searchsorted(tokens, edges).tolist(), len(tokens)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                used, place = _table(names, of[a:b])
                yield k, 1, None, None, None, _pack(_steps(used), place, _steps(tokens[a:b]))

    def scatter(batches):
        seen, sets, ids, held, deal = set(), [], [], 0, 0
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = shingles(text.as_py())
                name = xxhash.xxh3_64_intdigest(own.tobytes())
                deal += 1
                rows.append((deal % shards, 0, key, len(own), name - ((name >> 63) << 64) if len(own) else None, None))
                if len(own) and name not in seen:
                    seen.add(name)
                    sets.append(own)
                    ids.append(name)
                    held += len(own)
                if held >= FLUSH:
                    rows += flush(sets, ids)
                    sets, ids, held = [], [], 0
            if rows:
                yield _batch(rows)
        if sets:
            yield _batch(list(flush(sets, ids)))

    return scatter


def _gather(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Sets in order, and of the shingles of many blobs: the place of the set, the shingle, and what else there is."""
    names, parts = [], []
    for blob in blobs:
        used, place, steps, *more = _unpack(blob)
        names.append(np.cumsum(used))
        parts.append((place, np.cumsum(steps), *more))
    ids, inverse = np.unique(np.concatenate(names), return_inverse=True)
    starts = np.cumsum([0] + [len(x) for x in names])
    of = np.concatenate([inverse[s + p[0].astype(np.int64)].astype(np.uint32) for p, s in zip(parts, starts, strict=False)])
    return ids, of, *[np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]))]


def _split(table: pa.Table) -> dict[int, pa.Table]:
    kinds = np.asarray(table.column("kind"))
    return {k: table.filter(pa.array(kinds == k)) for k in np.unique(kinds).tolist()}


def _shared(shards: int):
    """One range of shingles: those in two sets or more go on to their sets' shards (kind 3), with their number of sets."""

    def shared(table: pa.Table) -> pa.Table:
        by_kind = _split(table)
        rows = [tuple(r.values()) for k in (0, 2) if k in by_kind for r in by_kind[k].to_pylist()]
        if 1 in by_kind:
            ids, of, tokens = _gather(by_kind[1].column("blob").to_pylist())
            order = np.lexsort((of, tokens))
            of, tokens = of[order], tokens[order]
            new = np.append(True, tokens[1:] != tokens[:-1])
            keep = new | np.append(True, of[1:] != of[:-1])  # a set that several tasks met counts once
            of, tokens = of[keep], tokens[keep]
            first = np.flatnonzero(new[keep])
            many = np.diff(np.append(first, len(tokens)))
            count = np.repeat(np.minimum(many, 65535), many).astype("<u2")
            keep = count > 1
            of, tokens, count = of[keep], tokens[keep], count[keep]
            home = (ids[of] % np.uint64(shards)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            home, of, tokens, count = home[order], of[order], tokens[order], count[order]
            for a, b in _runs(home):
                used, place = _table(ids, of[a:b])
                rows.append((int(home[a]), 3, None, None, None, _pack(_steps(used), place, _steps(tokens[a:b]), count[a:b])))
        return pa.Table.from_batches([_batch(rows)]) if rows else table.slice(0, 0)

    return shared


_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64()), ("m", pa.int32()), ("mins", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def ordered(table: pa.Table) -> pa.Table:
    """One shard of sets: shared shingles in global order (rarest first, then by hash) of those sets that can link.

    A set's own shingles come first in that order and match nothing. Where they fill the prefix that any
    partner has to meet, the set links with none and is left out.
    """
    by_kind = _split(table)
    out = []
    if 0 in by_kind:
        docs = by_kind[0]
        nothing = pa.nulls(len(docs))
        out.append(pa.Table.from_arrays([docs.column("kind"), docs.column("doc_id"), docs.column("n"), docs.column("set_id"), *[nothing.cast(t) for t in _SCHEMA.types[4:]]], schema=_SCHEMA))
    if 3 in by_kind:
        known = [_unpack(b) for b in by_kind[2].column("blob").to_pylist()]
        names, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in known]), return_index=True)
        sizes = np.concatenate([x[1] for x in known])[at].astype(np.int64)
        ids, of, tokens, count = _gather(by_kind[3].column("blob").to_pylist())
        sizes = sizes[np.searchsorted(names, ids)]
        m = np.bincount(of, minlength=len(ids))
        prefix = m - _need(sizes) + 1
        alive = (prefix > 0)[of]
        of, tokens, count = of[alive], tokens[alive], count[alive]
        order = np.lexsort((tokens, count, of))
        of, tokens = of[order], tokens[order]
        sets = np.flatnonzero(prefix > 0)
        starts = np.cumsum(m[sets]) - m[sets]
        if len(sets):
            with np.errstate(over="ignore"):
                mins = np.stack([np.minimum.reduceat(mix(tokens ^ s), starts) for s in _SEEDS], 1)
            own = [tokens[a : a + k] for a, k in zip(starts.tolist(), m[sets].tolist(), strict=True)]
            columns = [[3] * len(sets), [None] * len(sets), sizes[sets].tolist(), _signed(ids[sets]), m[sets].tolist(), [_signed(x) for x in mins],
                       [_signed(x[:k]) for x, k in zip(own, prefix[sets].tolist(), strict=True)], [x.astype("<u8").tobytes() for x in own]]
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA))
    return pa.concat_tables(out) if out else pa.Table.from_batches([], _SCHEMA)


class PrefixTree:
    """Sets as paths of their ordered shared shingles, kept as the tree's leaves in order with the depth each shares with the leaf before."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        """``sets``: (size, ordered shared shingles)."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i][1].tobytes())
        self.paths = [sets[i][1] for i in self.order]
        self.size = np.array([sets[i][0] for i in self.order], np.int64)
        self.long = np.array([len(x) for x in self.paths], np.int64)
        self.depth = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.paths[i - 1], self.paths[i]
            k = min(len(a), len(b))
            unlike = np.flatnonzero(a[:k] != b[:k])
            self.depth[i] = unlike[0] if len(unlike) else k
        many = self.long - _need(self.size) + 1
        heads = [x[:k] for x, k in zip(self.paths, many.tolist(), strict=True)]
        heads = heads or [np.empty(0, np.uint64)]
        keys = np.concatenate(heads)
        by_key = np.argsort(keys, kind="stable")
        self.keys = keys[by_key]
        self.leaf = np.repeat(np.arange(len(sets)), many)[by_key]
        self.place = np.concatenate([np.arange(len(x)) for x in heads])[by_key]

    def _reached(self, size: int, own: np.ndarray) -> np.ndarray:
        """Leaves whose prefix meets the set's, where the first shingle met leaves enough after it on both sides."""
        head = own[: len(own) - int(_need(size)) + 1]
        low, high = np.searchsorted(self.keys, head, "left"), np.searchsorted(self.keys, head, "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        leaf, first = np.unique(self.leaf[at], return_index=True)
        rest = np.minimum(len(own) - np.repeat(np.arange(len(head)), many)[first], self.long[leaf] - self.place[at][first])
        return leaf[rest >= _need_both(size, self.size[leaf])]

    def linked(self, size: int, own: np.ndarray, allowed: np.ndarray) -> list[int]:
        """The ``allowed`` leaves that link with the set (size, ordered shared shingles).

        Going from leaf to leaf, matches counted down to the depth they share are used again. Where the matches so
        far and the longest rest below cannot reach the least overlap below, the whole subtree is left at once.
        """
        leaves = self._reached(size, own)
        leaves = leaves[allowed[leaves]]
        if not len(leaves):
            return []
        # depth shared with the leaf looked at before, and bounds for all leaves that are left
        down = [0] + [int(self.depth[a + 1 : b + 1].min()) for a, b in zip(leaves[:-1].tolist(), leaves[1:].tolist(), strict=True)]
        needs, longest = _need_both(size, self.size[leaves]), int(self.long[leaves].max())
        least = int(needs.min())
        by_hash = np.argsort(own, kind="stable")
        known = own[by_hash]
        out, found, last, i = [], np.zeros(1, np.int64), np.full(1, -1), 0
        while i < len(leaves):
            d = min(down[i], len(found) - 1)
            rest = self.paths[leaves[i]][d:]
            at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
            hit = known[at] == rest
            place = np.maximum.accumulate(np.append(last[d], np.where(hit, by_hash[at], -1)))
            found = np.concatenate([found[:d], found[d] + np.append(0, np.cumsum(hit))])
            last = np.concatenate([last[:d], place])
            if found[-1] >= needs[i]:
                out.append(int(leaves[i]))
            i += 1
            # the first depth from which no leaf can link: its subtree ends at the first leaf that shares less
            dead = np.flatnonzero(found + np.minimum(longest - np.arange(len(found)), len(own) - 1 - last) < least)
            if len(dead):
                while i < len(leaves) and down[i] >= dead[0]:
                    i += 1
        return out


def _test(probes: list[tuple], members: list[tuple], same: bool):
    """Links between two lists of sets (set_id, comp, size, native, shingles), or within one; only those that join components."""
    tree = PrefixTree([(x[2], x[4]) for x in members])
    members = [members[i] for i in tree.order]
    if same:
        probes = members
    label = np.array([x[1] for x in members])
    native = np.array([x[3] for x in members], bool)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    for i, (name, comp, size, born, own) in enumerate(probes):
        allowed = label != top(comp)
        if not born:
            allowed &= native
        if same:
            allowed[: i + 1] = False
        for leaf in tree.linked(size, own, allowed):
            a, b = top(comp), top(int(label[leaf]))
            if a != b:
                root[b] = a
                label[label == b] = a
                yield name, members[leaf][0]


def _verify(batches):
    """Groups of rows (g, band, i, j, side, set_id, comp, n, native, tokens), in order: side 0 against the tree of side 1, or side 1 in itself."""

    def rows():
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            yield from zip(*columns, batch.column(9), strict=True)

    out = []
    for _, group in groupby(rows(), key=lambda r: r[:4]):
        sides: tuple[list, list] = ([], [])
        for *_, side, name, comp, n, native, tokens in group:
            sides[side].append((name, comp, n, native, np.frombuffer(tokens.as_buffer(), "<u8").copy()))
        out += _test(*sides, same=not sides[0])
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


_GROUP = ["g", "band", "i", "j"]


def _linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The links found in groups of sets (``_GROUP``, side, set_id, comp, native)."""
    full = rows.join(sets.select("set_id", "n", "tokens"), "set_id").select(*_GROUP, "side", "set_id", "comp", "n", "native", "tokens")
    dealt = full.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return stage(dealt.mapInArrow(_verify, "a long, b long"), "links")


def _trees(count, total):
    """How many trees a group of ``count`` sets with ``total`` shingles is dealt to."""
    return F.greatest(F.ceil(count / TREE_SETS), F.ceil(total / TREE_SHINGLES)).cast("int")


def _stars(sets: DataFrame) -> DataFrame:
    """Sets with a common minimum hash against the one of them with the least of its own, an original rather than a copy."""
    stars = sets.select("set_id", "n", "m", F.explode("mins").alias("least"))
    best = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("own"), "set_id", "n", "m")
    centers = stars.groupBy("least").agg(F.min(best).alias("c"), F.count("*").alias("k")).filter("k > 1").select("least", "c.*").toDF("least", "own", "g", "gn", "gm")
    most, both = F.least("m", "gm"), F.col("n") + F.col("gn")
    near = stars.join(centers, "least").filter("set_id <> g").filter((100 + PERCENT) * most >= PERCENT * both).select("g", "set_id", "m").distinct()
    near = stage(near, "near")
    size = near.groupBy("g").agg(_trees(F.count("*"), F.sum("m")).alias("trees"))
    one = [F.lit(0).alias("band"), F.lit(0).alias("i")]
    tail = [F.col("set_id").alias("comp"), F.lit(True).alias("native")]
    members = near.join(size, "g").select("g", *one, F.pmod(F.xxhash64("set_id"), "trees").cast("int").alias("j"), F.lit(1).alias("side"), "set_id", *tail)
    centers = size.select("g", *one, F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("j"), F.lit(0).alias("side"), F.col("g").alias("set_id"), F.col("g").alias("comp"), F.lit(True).alias("native"))
    return _linked(members.unionByName(centers), sets)


def _bridges(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Sets of different components that share a shingle of both prefixes: no link can miss that.

    Each such shingle names the least of its sets; sets under one name, of one band of sizes or the next, meet in a tree,
    so the sets of one family meet once and not once a shingle. Groups too large for a tree are dealt to several, and each
    two of these meet.
    """
    placed = sets.join(comps, sets.set_id == comps.node, "left").select("set_id", "n", "m", F.coalesce("comp", "set_id").alias("comp"), "prefix")
    prefixes = stage(placed.select("set_id", "comp", F.explode("prefix").alias("token")), "prefixes")
    heads = prefixes.groupBy("token").agg(F.min("set_id").alias("g"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token", "g")
    named = stage(prefixes.join(heads, "token").select("g", "set_id", "comp").distinct(), "named")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    sized = named.join(sets.select("set_id", "m", band.alias("own")), "set_id")
    banded = sized.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("native", F.col("own") == F.col("band"))
    groups = banded.groupBy("g", "band").agg(_trees(F.count("*"), F.sum("m")).alias("trees"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("native").alias("some"))
    groups = groups.filter("x <> y AND some").select("g", "band", "trees")
    dealt = banded.join(groups, ["g", "band"]).withColumn("tree", F.pmod(F.xxhash64("set_id"), "trees").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    i, j = F.least("tree", "other"), F.greatest("tree", "other")
    side = F.when(F.col("tree") == F.col("other"), 1).otherwise((F.col("tree") > F.col("other")).cast("int"))
    return _linked(met.select("g", "band", i.alias("i"), j.alias("j"), side.alias("side"), "set_id", "comp", "native"), sets)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) for each row of ``docs``.

    Equal sets are one class from the start. 1. Shingles are counted by ranges of their hashes and each set gets its
    shared ones in global order, rarest first. 2. Stars: sets with a common minimum hash are tested against one center,
    which joins most near copies without all their pairs. 3. Bridges: sets of different components whose prefixes meet
    are tested, so no link is missed. All tests go through prefix trees, and links between components alone go on.

    Null and empty texts, and texts of white space, have an empty set and stand alone. A null id takes part in
    links but names no component unless it stands alone (then null). Repeated rows are documents of their own.
    Shingles and sets are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(12, -(-size // SHARD_BYTES))
    scattered = rows.mapInArrow(_scatter(shards), _ROW)
    shared = scattered.groupBy("shard").applyInArrow(_shared(shards), _ROW)
    table = stage(shared.groupBy("shard").applyInArrow(ordered, _SET), "shingle-sets")
    members = table.filter("kind = 0").select("doc_id", "n", "set_id")
    sets = table.filter("kind = 3").drop("kind", "doc_id")

    comps = connected_components(_stars(sets))
    bridged = _bridges(sets, comps)
    comps = connected_components(comps.toDF("a", "b").unionByName(bridged))
    classes = members.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    classes = classes.join(comps, classes.set_id == comps.node, "left").select("set_id", "first", F.coalesce("comp", "set_id").alias("comp"))
    classes = stage(classes, "classes")
    heads = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = stage(classes.join(heads, "comp").select("set_id", "component_id"), "components")
    full = members.filter("n > 0").join(named, "set_id")
    alone = members.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"]
    return full.select(*columns).unionByName(alone.select(*columns))


def query(spark, sf_dir):
    from .common import documents

    return ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON r.y = l.x)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON s.doc_id = r.x
"""
