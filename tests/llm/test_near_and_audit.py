"""SimHash near-dedup, hard-negative mining and the filter audit against brute force, on small tables with awkward rows."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import filter_audit, hard_negatives, queries, simhash
from tessera.llm.ball_tree import BallTree, Best
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base, base + " more", None, "", " \n\t ", "one two", "One TWO", "é ж 日本 $ \x00 x\x1fy", "x" * 70_000, " ".join(f"v{i}" for i in range(80_000)), "SHOUT " * 60, base.upper(), base]
    rows = [(i, t, "en", f"s{i % 2}", 7, "old") for i, t in enumerate(texts)] + [(13, base, None, None, None, None), (None, base, None, "", None, None), (None, "one two", None, "s0", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long, sha string")


def roots(n, near):
    home = list(range(n))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                home[root(i)] = root(j)
    return [root(i) for i in range(n)]


def print_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_brute(rows):
    prints = [print_of(r.text) for r in rows]
    top = roots(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for r, t in zip(rows, top, strict=True):
        if r.doc_id is not None:
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    return sorted([(r.doc_id, f"{p:016x}", least.get(t)) for r, p, t in zip(rows, prints, top, strict=True)], key=str)


def test_simhash(spark, awkward):
    got = sorted((tuple(r) for r in simhash.simhash_components(awkward).collect()), key=str)
    assert got == simhash_brute(awkward.collect())
    assert simhash.simhash_components(awkward.limit(0)).count() == 0
    assert simhash.simhash_components(awkward.limit(0).select("doc_id", "text")).columns == ["doc_id", "fingerprint", "component_id"]


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in queries.QUERIES["op11_simhash"](spark, SF).collect()), key=str) == simhash_brute(rows)


def near_prints(seed, families, copies):
    """Fingerprints within some bits of the first of their family, and lone ones."""
    rng, out = random.Random(seed), {0, (1 << 64) - 1}
    for k in range(families):
        base = rng.getrandbits(64)
        for _ in range(copies):
            out.add(base ^ sum(1 << b for b in rng.sample(range(64 if k % 2 else 20), rng.randint(0, 6))))
    return np.array(sorted(out | {rng.getrandbits(64) for _ in range(50)}), np.uint64)


@pytest.mark.parametrize("most", [2048, 3])
def test_simhash_index_loses_no_link(spark, monkeypatch, most):
    """Lists compared as they are, and all lists looked up by five places."""
    monkeypatch.setattr(simhash, "MAX_LIST", most)
    prints = near_prints(5, 8, 40)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f long")
    edges = [(np.int64(a).astype(np.uint64), np.int64(b).astype(np.uint64)) for a, b in (tuple(r) for r in simhash.near_edges(frame).collect())]
    at = {x: i for i, x in enumerate(prints.tolist())}
    met = {(at[int(a)], at[int(b)]) for a, b in edges}
    want = roots(len(prints), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 3)
    got = roots(len(prints), lambda i, j: (i, j) in met or (j, i) in met)
    same = lambda x: {tuple(i for i in range(len(x)) if x[i] == r) for r in set(x)}
    assert same(got) == same(want) and len(set(want)) > 55


def test_dense_lists():
    """Breadth first and by neighbours give the same components; the hottest list needs no more than its own rows."""
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 20, 3000).astype(np.uint64) | np.uint64(0xABCDEF << 40))
    parts = []
    for edges in (simhash.forest(prints), simhash.dense_forest(prints)):
        assert len(edges[0]) < len(prints)
        home = {int(x): int(x) for x in prints}

        def root(x, home=home):
            while home[x] != x:
                x = home[x]
            return x

        for a, b in zip(*edges, strict=True):
            x, y = root(int(a)), root(int(b))
            home[max(x, y)] = min(x, y)
        parts.append([root(int(x)) for x in prints])
    assert parts[0] == parts[1]


def mined(rows, is_anchor, scale=256):
    """Anchors with their positives and negatives, by sorting all rows for each."""
    live = [(i, r.vec_id, r.label, [math.floor(scale * x) for x in r.embedding]) for i, r in enumerate(rows)
            if r.vec_id is not None and r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, vec, label, v in live:
        if not is_anchor(vec):
            continue
        ranked = sorted((-dot(v, w), o, k != label) for j, o, k, w in live if j != i)
        for p, pos, _ in [x for x in ranked if not x[2]][:5]:
            fit = [x for x in ranked if x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(vec, pos, n + 1, x[1], -p, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls, bad components, short and empty vectors, copies, repeated rows, ties and clashing names."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(6)], rng.randint(0, 2)) for i in range(120)]
    rows += [rows[10], rows[10], (200, rows[3][1], 1), (201, rows[3][1], 2), (202, rows[3][1], 0), (203, [0.5, 0.2], 1), (204, [], 1), (205, [0.0] * 6, 2)]
    rows += [(206, None, 1), (207, [0.1, None], 1), (208, [float("nan"), 0.1], 1), (209, [float("inf"), 0.1], 1), (210, [0.1], None), (None, [0.3] * 6, 1), (211, [3e38, 0.1], 1), (212, [0.4] * 6, 9)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_hard_negatives(vectors):
    every = lambda df: sorted(tuple(r) for r in df.collect())
    want = mined([r for r in vectors.collect() if r.vec_id != 211], lambda i: i % 10 == 0)
    assert len(want) > 60
    assert every(hard_negatives.hard_negatives(vectors, F.col("id") % 10 == 0)) == want
    assert every(hard_negatives.hard_negatives(vectors.limit(0), F.col("id") % 10 == 0)) == []
    assert every(hard_negatives.hard_negatives(vectors, F.lit(False))) == []


def test_hard_negatives_in_many_cells(vectors, monkeypatch):
    """Small trees, groups of few anchors and many slabs give the same rows."""
    for name, value in (("TREE_ROWS", 16), ("CELL_ANCHORS", 3), ("CELL_TREES", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.hard_negatives(vectors.repartition(3), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined([r for r in vectors.collect() if r.vec_id != 211], lambda i: i % 10 == 0)


def test_ball_tree_prunes_and_stays_exact():
    """Clustered rows: far nodes go unread, beneath the k-th best and outside a window; also by integers beyond a double's."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-900, 900, (40, 8))
    rows = (centers[rng.integers(0, 40, 6000)] + rng.integers(-20, 20, (6000, 8))).astype(np.int64)
    labels, ids = rng.integers(0, 2, 6000), rng.permutation(6000).astype(np.int64)
    asked = rows[:50]
    for factor in (1, 50_000):
        tree = BallTree.from_bytes(BallTree(rows * factor, ids, labels, np.arange(6000)).to_bytes())
        scores = (asked * factor) @ (rows * factor).T
        for same_label, low, high in ((True, None, None), (False, 0.5, 0.6)):
            best = [Best(50, 4)]
            lowest = np.full((50, 1), -(2**62)) if low is None else (scores.max(axis=1, keepdims=True) * low).astype(np.int64)
            highest = np.full((50, 1), 2**62) if high is None else (scores.max(axis=1, keepdims=True) * high).astype(np.int64)
            read = tree.search(asked * factor, labels[:50], same_label, lowest, highest, best, np.arange(50) if same_label else None)
            assert read < 0.5 * 50 * 6000
            for q in range(50):
                fits = [(-scores[q, j], ids[j]) for j in range(6000) if (labels[j] == labels[q]) == same_label and lowest[q] <= scores[q, j] <= highest[q] and (not same_label or j != q)]
                found = [(-s, i) for s, i in zip(best[0].score[q], best[0].id[q], strict=True) if s > -(2**62)]
                assert found == sorted(fits)[:4]


def test_hard_negatives_query(spark, duck):
    same_rows(queries.QUERIES["op12_hard_negatives"](spark, SF).toPandas(), duck.execute(queries.ORACLE["op12_hard_negatives"]).fetchdf())


def audited(rows, labels):
    marks = {}
    for d, q, x in labels:
        good, bad = marks.get(d, (False, False))
        marks[d] = (good or q == 1, bad or x == 1)
    order = lambda i: -(2**63) if i is None else i
    docs = []
    for r in rows:
        text = r.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": any((o.text or "") == text and order(o.doc_id) < order(r.doc_id) for o in rows)}
        docs.append((r.source or "", {k for k, v in fails.items() if v}, *(marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False))))
    out, removed = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for p in permutations("ABCDE"):
            left = own
            for step, f in enumerate(p, 1):
                gone = [d for d in left if f in d[1]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                redundant = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                out.append((part, "".join(p), step, len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark, awkward):
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (13, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (11, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = awkward.collect()
    assert sorted(tuple(r) for r in filter_audit.filter_audit(awkward, frame).collect()) == audited(rows, labels)
    unique = awkward.filter("doc_id < 13")
    assert sorted(tuple(r) for r in filter_audit.filter_audit(unique, frame).collect()) == audited(unique.collect(), labels)
    without = filter_audit.filter_audit(unique)
    assert without.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert filter_audit.filter_audit(awkward.limit(0), frame).count() == 0


def test_filter_audit_query(spark, duck):
    same_rows(queries.QUERIES["op13_filter_audit"](spark, SF).toPandas(), duck.execute(queries.ORACLE["op13_filter_audit"]).fetchdf())


def test_hot_text_is_counted_before_it_meets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"), F.lit("one").alias("source"))
    row = filter_audit.filter_audit(docs).filter("filter_order = 'EABCD' and step = 1").first()
    assert (row.kept, row.removed, row.unique_fails) == (2001, 999, 0)
    got = simhash.simhash_components(docs)
    assert got.filter("doc_id % 3 = 0").select("component_id").distinct().count() == 1
