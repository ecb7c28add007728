"""The corpus operators against brute force and public libraries, on small tables with awkward rows."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat, components, exact_dedup, line_dedup, media, ngram_join, packing, pretoken, quality, token_files, toxicity
from tessera.llm.cuckoo import CuckooFilter
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
LINE = "a line that is long enough to count here"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base, base + " more", None, "", " \n\t ", "one two", "One TWO", "é ж 日本 <|endoftext|> 's  x", "x" * 70_000, "\n".join([LINE, "short", "  " + LINE.upper() + "\t"]), LINE, LINE + "\n" + LINE, base]
    rows = [(i, t, "en", "keep", 7, "old") for i, t in enumerate(texts)] + [(13, base, None, None, None, None), (None, LINE, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, n_chars long, Score string")


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


def test_exact_dedup(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward).collect()
    rows = awkward.collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x.doc_id for x in rows if (x.text or "") == (r.text or "")]
        top = max((x for x in same if x is not None), default=None)
        assert (r.group_size, r.keep_id, r.kept) == (len(same), top, r.doc_id == top)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert "lang" in got[0]


def test_exact_dedup_beyond_the_broadcast(awkward, monkeypatch):
    want = sorted((tuple(r) for r in exact_dedup.exact_dedup(awkward).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BITS", 0)
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(awkward).collect()), key=str) == want


def test_exact_dedup_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs)
    assert {(r.group_size, r.keep_id) for r in got.filter("doc_id % 3 = 0").collect()} == {(2000, 5997)}
    assert got.filter("kept").count() == 4001


def jaccard_components(rows):
    def grams(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for s in "\t\n\v\f\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(r.text) for r in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                home[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x.doc_id for k, x in enumerate(rows) if root(k) == root(i) and x.doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def test_ngram_join(spark, awkward, nothing):
    got = ngram_join.ngram_components(awkward).collect()
    assert sorted([tuple(r) for r in got], key=str) == jaccard_components(awkward.collect())
    assert ngram_join.ngram_components(nothing).count() == 0
    rng, words = random.Random(3), [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted([tuple(r) for r in ngram_join.ngram_components(docs).collect()], key=str) == jaccard_components(docs.collect())


def near_sets(seed, families, copies, lowest, highest):
    """Texts of families of near copies, the more edited the further down, with a passage that all share."""
    rng, words = random.Random(seed), [f"v{i}" for i in range(3000)]
    passage, texts = " ".join(rng.choices(words, k=12)), []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(lowest, highest))
        for k in range(copies):
            copy = list(base)
            for _ in range(k // 6):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(passage + " " + " ".join(copy[: len(copy) - k % 5]))
    return texts


def test_ngram_join_in_many_trees(spark, monkeypatch):
    """Groups dealt to many trees and many shards lose no link."""
    docs = spark.createDataFrame(list(enumerate(near_sets(11, 5, 40, 60, 90))), "doc_id long, text string")
    want = jaccard_components(docs.collect())
    assert len({x[2] for x in want}) > 10
    monkeypatch.setattr(ngram_join, "TREE_SETS", 6)
    monkeypatch.setattr(ngram_join, "SHARD_BYTES", 500)
    assert sorted([tuple(r) for r in ngram_join.ngram_components(docs).collect()], key=str) == want


def test_bridges_alone_find_all(spark, monkeypatch):
    """Without the stars, which only spare work, the result is the same."""
    docs = spark.createDataFrame(list(enumerate(near_sets(12, 4, 30, 30, 60))), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "_stars", lambda sets: spark.createDataFrame([], "a long, b long"))
    assert sorted([tuple(r) for r in ngram_join.ngram_components(docs).collect()], key=str) == jaccard_components(docs.collect())


def test_scatter_and_gather_are_lossless():
    rng = np.random.default_rng(2)
    for wide in (np.uint16, np.uint32, np.uint64):
        x = rng.integers(0, np.iinfo(wide).max, 1000, wide)
        y, z = ngram_join._unpack(ngram_join._pack(x, x[:0]))
        assert (y == x).all() and len(z) == 0
    tokens = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    assert (np.cumsum(ngram_join._steps(tokens)) == tokens).all()


@pytest.mark.parametrize("seed", range(4))
def test_prefix_tree_finds_all(seed):
    rng = np.random.default_rng(seed)
    order = rng.permutation(1000).astype(np.uint64)
    place = {int(t): i for i, t in enumerate(order)}
    base = set(rng.choice(1000, 60, replace=False).tolist())

    def near(k):
        return sorted((base - set(list(base)[:k])) | set(rng.choice(1000, k).tolist()), key=place.get)

    sets = [near(k) for k in range(30) for _ in range(5)]
    tree = ngram_join.PrefixTree([(len(s), np.array(s, np.uint64)) for s in sets])
    for probe in (sorted(base, key=place.get), sets[70], sets[-1]):
        want = [i for i, s in enumerate(sets) if 100 * len(set(s) & set(probe)) >= 75 * len(set(s) | set(probe))]
        got = tree.linked(len(probe), np.array(probe, np.uint64), np.ones(len(sets), bool))
        assert sorted(tree.order[i] for i in got) == want and want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (80, 80)], "a long, b long")
    got = {r.node: r.comp for r in components.connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[60] == got[70] == 50 and 80 not in got
    assert components.connected_components(edges.limit(0)).count() == 0


def kept_lines(rows):
    key = lambda line: line.strip(" \t\n\v\f\r").encode().lower().decode()
    held = {}
    number = lambda r: -(2**63) if r.doc_id is None else r.doc_id
    for i, r in enumerate(rows):
        for line in (r.text or "").split("\n"):
            held.setdefault(key(line), {})[i] = number(r)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and number(r) != max(held[key(x)].values()))]
        out.append((r.doc_id, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_line_dedup(awkward, nothing):
    got = line_dedup.line_dedup(awkward)
    assert sorted([(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()], key=str) == kept_lines(awkward.collect())
    assert line_dedup.line_dedup(nothing).count() == 0
    assert set(awkward.columns) <= set(got.columns)


def test_line_dedup_beyond_the_broadcast(spark, awkward, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted(((r.doc_id, r.kept_text, r.n_dropped) for r in df.collect()), key=str)
    want = [rows(line_dedup.line_dedup(x)) for x in (docs, awkward)]
    assert sum(x[2] for x in want[0])
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", 0)
    assert [rows(line_dedup.line_dedup(x)) for x in (docs, awkward)] == want
    monkeypatch.setattr(line_dedup, "MAX_ID_BITS", 0)
    assert [rows(line_dedup.line_dedup(x)) for x in (docs, awkward)] == want


def test_only_documents_that_lose_lines_are_shuffled(spark):
    docs = spark.range(3000).select(F.col("id").alias("line_doc"), F.lit("t").alias("text"))
    lost = spark.range(0, 3000, 100).select(F.col("id").alias("d"))
    marked = line_dedup._touched(docs, lost, "line_doc", "maybe")
    moved = {r.line_doc for r in marked.filter("maybe").collect()}
    assert set(range(0, 3000, 100)) <= moved and len(moved) < 45
    assert marked.columns == ["line_doc", "text", "maybe"] and marked.count() == 3000
    plan = marked.filter("not maybe")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "text" in x]


def test_media_that_cannot_be_read(spark):
    good = media.png_encode(b"some text")
    rows = [(1, good), (2, None), (3, b""), (4, b"no image"), (5, good[:-20]), (6, good[:60] + b"\x00" + good[61:])]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].n_bytes == 9 and got[1].error is None and got[2].payload is None and got[2].error is None
    assert all(got[i].payload is None and got[i].feature is None and got[i].error for i in (3, 4, 5, 6))


def test_line_dedup_grows(spark, monkeypatch):
    """Adding known documents again counts them once, and filters are dealt to more shards as the index grows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted((r.doc_id, r.kept_text, r.n_dropped) for r in df.collect())
    want = rows(line_dedup.line_dedup(docs))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    index = line_dedup.build_index(docs.filter("doc_id < 12"))
    grown = line_dedup.add_documents(index, docs.filter("doc_id >= 10"))
    assert grown.shards > index.shards
    assert rows(line_dedup.apply_index(grown, docs)) == want
    assert rows(line_dedup.apply_index(line_dedup.add_documents(grown, docs.filter("doc_id < 50")), docs)) == want


def test_line_dedup_is_reversible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    old, new = docs.filter("doc_id < 120"), docs.filter("doc_id >= 120")
    index = line_dedup.build_index(old)
    grown = line_dedup.add_documents(index, new)
    back = line_dedup.remove_documents(grown, new.select("doc_id"))
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "kept_text", "n_dropped").collect())
    assert rows(line_dedup.apply_index(grown, docs)) == rows(line_dedup.line_dedup(docs))
    assert rows(line_dedup.apply_index(back, old)) == rows(line_dedup.apply_index(index, old))


def test_cuckoo_filter():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    f = CuckooFilter(5000)
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[:2500])
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01
    assert not CuckooFilter(8).insert(keys[:200])


def test_media(awkward, nothing):
    rows = media.read_media(media.with_media(awkward)).collect()
    for r in rows:
        raw = (r.text or "").encode()
        assert r.payload[: r.n_bytes] == raw and len(r.payload) % 576 == 0 and r.payload and set(r.payload[r.n_bytes :]) <= {255}
    assert len(rows) == awkward.count() and len(rows[0].feature) == 16
    assert media.with_media(nothing).count() == 0
    damaged = bytearray(media.png_encode(b"abc"))
    damaged[60] ^= 1
    with pytest.raises((ValueError, zlib.error, struct.error)):
        media.png_decode(bytes(damaged))


def test_png_filters():
    image = np.random.default_rng(0).integers(0, 256, (10, 23)).astype(np.uint8)
    lines, before = [], [0] * 23
    for y, row in enumerate(image.tolist()):
        line = [y % 5]
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            line.append((v - [0, a, b, (a + b) // 2, media._paeth(a, b, c)][y % 5]) & 255)
        lines.append(bytes(line))
        before = row
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 23, 10, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.png_decode(png)[0] == image).all()


def fuzz(n):
    rng = random.Random(1)
    marks = list("ab Cé'\n\t  sd1²½ß.,!\x85\xa0\x1c") + ["'s", "'ll", " \n", "  ", "日", "ж", "é", "İ", "<|endoftext|>", " ", "the"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_library_ids(name, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    texts = fuzz(3000)
    want = [np.asarray(x.ids, "<u2").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    encoder = pretoken.library_encoder(P.path(name))
    assert encoder.encode(texts) == want
    monkeypatch.setattr(pretoken, "WORDS", 20)
    encoder.forget()
    assert encoder.encode(texts) == want


def test_other_tokenizer_files(tmp_path):
    """A file with settings of its own has its texts encoded whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "own.json"))
    texts = fuzz(300)
    want = [np.asarray(x.ids, "<u2").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert pretoken.library_encoder(str(tmp_path / "own.json")).encode(texts) == want


def test_byte_bpe_with_another_pattern(spark):
    import tiktoken

    path, pattern = P.path(byte_bpe.VOCABULARY), r"\S+|\s+"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(fuzz(200))), "doc_id long, text string")
    for r in byte_bpe.encode_bpe(docs, path, pattern).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == e.encode_ordinary(r.text)


def test_byte_bpe(awkward, nothing):
    import tiktoken

    path = P.path(byte_bpe.VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, texts = byte_bpe.load(path, P.PATTERN), fuzz(2000)
    assert [np.frombuffer(x, "<u2").tolist() for x in bpe.encoder.encode(texts)] == [e.encode_ordinary(t) for t in texts]
    assert sorted(bpe.perfect.slots(np.array([byte_bpe.xxhash.xxh3_64_intdigest(t) for t in bpe.tokens], np.uint64)).tolist()) == list(range(len(bpe.tokens)))
    for r in byte_bpe.decode_bpe(byte_bpe.encode_bpe(awkward, path), path).collect():
        assert r.decoded == (r.text or "").encode() and r.ids_text == " ".join(map(str, e.encode_ordinary(r.text or "")))
    assert byte_bpe.encode_bpe(nothing, path).count() == 0


def test_token_files(spark, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_files.VOCABULARY))
    files = token_files.write_token_files(awkward, P.path(token_files.VOCABULARY), str(tmp_path / "a"))
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(14), 13][:15] + [13]
    at = 0
    by_id = {}
    for r in awkward.collect():
        by_id.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        assert np.frombuffer(r.ids, "<u4").tolist() in by_id[r.doc_id]
        at += r.n_tokens
    empty = token_files.write_token_files(nothing, P.path(token_files.VOCABULARY), str(tmp_path / "b"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_variable_length_coding():
    values = np.random.default_rng(0).integers(0, 2**32, 10_001) >> np.random.default_rng(1).integers(0, 32, 10_001)
    assert (token_files.unpack_values(*token_files.pack_values(values), len(values)) == values).all()


def test_packing(awkward, nothing):
    rows = packing.pack_documents(awkward, P.path(packing.VOCABULARY), capacity=64).collect()
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.start == 64 * r.piece
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(nothing, P.path(packing.VOCABULARY)).count() == 0


def test_slot_plan_is_best_fit():
    counts = {4096: 3, 3000: 5, 1000: 9, 96: 40, 1: 7}
    runs = packing.plan_slots(counts)
    used = {}
    for length, _, many, first, offset in runs.tolist():
        for s in range(first, first + many):
            used.setdefault(s, []).append((offset, length))
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    assert all(sum(x for _, x in v) <= 4096 and sorted(v)[0][0] == 0 for v in used.values())
    assert len(used) == -(-sum(k * v for k, v in counts.items()) // 4096)


def test_chat_layouts(spark):
    records = ['{"prompt":"a|b","completion":"c\\\\d"}', '{"instruction":"i","input":"","output":"o"}', '{"instruction":"i","output":"o"}', '{"messages":[{"role":"user","content":"x"},{"content":"<|end|>\\n","role":"assistant"}]}',
               '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}', "no json", None, '{"z":1}', '{"messages":[]}', '{"id":7,"source":"s","prompt":"p","response":"r"}', '{"turns":[{"role":"user","text":"t","at":1},{"text":"u"}],"x":{"y":[1]}}', '{"prompt":{"a":1},"completion":"c"}', '{"messages":[{"content":"c"}]}']
    df = spark.createDataFrame(list(enumerate(records)), "id int, j string")
    turns = chat.canonical_json(df, "id", "j")
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(turns.select("conv_id", "turns"))).collect()}
    known = {r.conv_id: r for r in turns.collect()}
    assert [known[i].layout for i in range(8)] == ["prompt", "instruction_input", "instruction", "messages", "shared", None, None, None]
    assert [known[i].layout for i in range(8, 13)] == ["messages", "prompt_response", "turns", None, None]
    assert known[8].turns == [] and [tuple(x) for x in known[10].turns] == [("user", "t"), ("", "u")]
    assert all(back[i].turns == known[i].turns for i in known)
    assert [back[i].loss_text for i in range(5)] == ["c\\d", "o", "o", "<|end|>\n", ""]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.range(1), "id")


def test_chat_query(spark, duck):
    same_rows(chat.query(spark, SF).toPandas(), duck.execute(chat.ORACLE).fetchdf())


@pytest.mark.parametrize("module", [exact_dedup, line_dedup, ngram_join])
def test_sql_twins(spark, duck, module):
    same_rows(module.query(spark, SF).toPandas(), duck.execute(module.ORACLE).fetchdf())


@pytest.mark.parametrize(("module", "label", "train", "score", "recall", "precision"), [
    (toxicity, "toxic", toxicity.train, toxicity.score_toxicity, 0.83, 0.9),
    (quality, "quality", quality.train, quality.score_quality, 0.97, 0.97),
])
def test_classifiers(spark, awkward, nothing, module, label, train, score, recall, precision):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = train(docs, labels)
    held = score(docs, model).join(labels, "doc_id").filter("held_out")
    yes, said, both, all_ = held.agg(F.sum(label), F.sum("predicted"), F.sum(F.col(label) * F.col("predicted")), F.count("*")).first()
    assert both / yes >= recall and both / said >= precision and yes < all_
    rows = score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert score(nothing, model).count() == 0
    empty = train(nothing, labels.limit(0))
    assert {r.predicted for r in score(awkward, empty).collect()} == {0}


def labelled(n):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(rng.randint(0, 1), rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]
    return [(" ".join([*w, *(["bad", "bad"] if y else ["good"])]), y) for y, w in rows]


def test_toxicity_learns_as_plain_ftrl():
    """Steps coordinate by coordinate give the same weights."""
    rows = labelled(60)
    known = [toxicity.features(t) for t, _ in rows]
    z, n = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    toxicity._learn(known, [y for _, y in rows], z, n)
    own_z, own_n = {}, {}

    def weight(i):
        if abs(own_z.get(i, 0)) <= toxicity.L1:
            return 0.0
        sign = 1 if own_z[i] > 0 else -1
        return -(own_z[i] - sign * toxicity.L1) / ((toxicity.BETA + own_n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for (at, words), (_, y) in zip(known, rows, strict=True):
            x = {int(i): 1.0 if k < words else toxicity.PAIR for k, i in enumerate(at)}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * (toxicity.POSITIVE_WEIGHT if y else 1.0) * x[i]
                rate = ((own_n.get(i, 0) + g * g) ** 0.5 - own_n.get(i, 0) ** 0.5) / toxicity.ALPHA
                own_z[i] = own_z.get(i, 0) + g - rate * w[i]
                own_n[i] = own_n.get(i, 0) + g * g
    assert len(own_z) == np.count_nonzero(n) and any(weight(i) for i in own_z)
    assert all(abs(z[i] - v) < 1e-9 for i, v in own_z.items())


def test_best_cut():
    rng = np.random.default_rng(0)
    logits, labels = np.round(rng.normal(0, 1, 300), 1), (rng.random(300) < 0.3).astype(int)
    logits = logits + labels - 2
    f1 = lambda c: 2 * labels[logits >= c].sum() / ((logits >= c).sum() + labels.sum())
    assert f1(toxicity.best_cut(logits, labels)) >= max(f1(c) for c in logits) - toxicity.SLACK
    assert toxicity.best_cut(logits, labels * 0) == toxicity.best_cut(logits[:0], labels[:0]) == toxicity.PLAIN


def test_cut_of_a_model_that_tells_nothing():
    """Marking every row has the best F1 of scores without a meaning; the cut marks none instead."""
    rng = np.random.default_rng(1)
    labels = np.zeros(200, int)
    labels[rng.choice(200, 20, replace=False)] = 1
    for logits in (np.zeros(200), np.where(labels == 1, -1.0, rng.normal(0, 0.1, 200)), np.where(labels == 1, 4.0, 5.0)):
        assert not (logits >= toxicity.best_cut(logits, labels, toxicity.LEAST_PRECISION)).any()
    clear = np.where(labels == 1, 1.0, -1.0)
    assert ((clear >= toxicity.best_cut(clear, labels, toxicity.LEAST_PRECISION)) == (labels == 1)).all()


def test_quality_pairs_and_gradient():
    """The sum-of-squares identity against all pairs, and one step against numeric differences."""
    import pandas as pd

    text, rng = labelled(1)[0][0], np.random.default_rng(3)
    at, x = quality.features(text, len(text))
    w, v = rng.normal(0, 1, quality.WIDTH), rng.normal(0, 1, (quality.WIDTH, quality.FACTORS))
    pairs = sum(v[at[i]] @ v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(quality._logit(w[at], v[at], x)[0] - (w[at] @ x + pairs)) < 1e-9
    state = {"w": w.copy(), "v": v.copy(), "gw": np.zeros(quality.WIDTH), "gv": np.zeros(v.shape)}
    quality._epoch(pd.DataFrame({"t": [text], "stated": [len(text)], "y": [1]}), state, 0)

    def loss(ww, vv):
        return np.log1p(np.exp(-quality._logit(ww[at], vv[at], x)[0])) + quality.DECAY / 2 * ((ww[at] ** 2).sum() + (vv[at] ** 2).sum())

    for k in (0, len(at) // 2, len(at) - 1):
        up, down = v.copy(), v.copy()
        up[at[k], 2] += 1e-5
        down[at[k], 2] -= 1e-5
        slope = (loss(w, up) - loss(w, down)) / 2e-5
        assert abs(np.sqrt(state["gv"][at[k], 2]) - abs(slope)) < 1e-4 * max(1, abs(slope))


def test_chat_of_awkward_rows(spark):
    """Null ids, roles and texts, repeated turns, control strings, an empty table, other columns, a long conversation."""
    rows = [(1, 0, "user", "a<|end|>\n", "x"), (1, 0, "user", "a<|end|>\n", None), (1, 1, "assistant", None, ""), (None, 0, None, "b|\\", "x"), (2, None, "assistant", "c", None)]
    rows += [(3, i, ("user", "assistant")[i % 2], f"<|user|>\nturn {i}", None) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, Turns string")
    out = {r.conv_id: r for r in chat.read_chat(chat.format_chat(chat.canonical_turns(chat.gather_turns(df), "conv_id"))).collect()}
    assert [tuple(x) for x in out[1].turns] == [("user", "a<|end|>\n")] * 2 + [("assistant", "")] and out[1].loss_text == ""
    assert [tuple(x) for x in out[None].turns] == [("", "b|\\")] and out[2].loss_text == "c"
    assert out[3].loss_text == "".join(f"<|user|>\nturn {i}" for i in range(1, 2000, 2))
    assert chat.read_chat(chat.format_chat(chat.canonical_turns(chat.gather_turns(df.limit(0)), "conv_id"))).count() == 0


def test_pipeline_stages_on_awkward_rows(spark):
    """Columns named like the models' keep their values; copies without an id, or with one id, go; empty tables pass."""
    import corpus_pipeline as c

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "own"), (1, text, "own"), (None, text, "own"), (None, text + " more", "own"), (2, "", "own"), (3, None, "own"), (None, None, None), (4, "one two three", "own"), (4, "four five six", "own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), o, 0.5, "x") for i, t, o in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, Predicted double, kept_text string")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and {r.score for r in got} <= {"own", None} and {r.Predicted for r in got} <= {0.5} and {r.kept_text for r in got} <= {"x"}
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "ngram_join":
            assert sorted((r.text or "")[:9] for r in got) == ["", "", "", "four five", "one two t", "w0 w1 w2 "]
        if name == "line_dedup":
            assert len(got) == len(rows)
    assert c.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = c.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_drops_its_tables(spark):
    """What stays in the shared folder is what the result reads: the last documents and the packing's tables."""
    import corpus_pipeline as c
    from tessera.llm import common

    before = common.staged()
    out = c.run(spark, SF)
    names = [x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in common.staged() if x not in before]
    assert sorted(names) == ["piece-counts", "pieces", "pipeline-ngram_join"]
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(f"n > {packing.CAPACITY}").count() == 0


def test_pieces_are_the_library_ids(spark, awkward):
    """Lengths, starts and checksums of cut documents against the library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = []
    for r in awkward.collect():
        ids = np.asarray(t.encode(r.text or "", add_special_tokens=False).ids + [packing.END], "<u4")
        want += [(r.doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    rows = packing.pack_documents(awkward, P.path(packing.VOCABULARY), capacity=64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)


def test_media_digests(spark):
    """The query's digests from plain zlib and hashlib; equal texts give equal rows."""
    rows = [(i, t) for i, t in enumerate(["a", "", None, "x" * 576, "é" * 400, "a"])]
    got = {r.doc_id: r for r in media.read_media(media.with_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert got[i].payload == padded and got[i].n_bytes == len(raw)
        assert media.png_decode(got[i].media)[0].tobytes() == padded
    assert (got[0].media, got[0].feature) == (got[5].media, got[5].feature) and got[0].feature != got[4].feature
