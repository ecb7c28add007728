"""Whole queries and the pipeline's decisions against public libraries and brute force on the smallest documents."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import byte_bpe, chat, common, media, packing, quality, token_files, toxicity
from tests.llm.test_operators import SF, jaccard_components, kept_lines


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(common.documents(spark, SF).collect(), key=lambda r: r.doc_id)


def test_token_files_query(spark, docs):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(P.path(token_files.VOCABULARY)), 0, {}
    for r in docs:
        ids = np.asarray(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, SF).collect()} == want


def test_media_query(spark, docs):
    """Digests of the padded bytes; the stored form is an image that plain chunks hold."""
    got = {r.doc_id: r for r in media.query(spark, SF).collect()}
    stored = {r.doc_id: r.media for r in media.with_media(common.documents(spark, SF).select("doc_id", "text")).collect()}
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        raw = (r.text or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def test_cosine_hash_by_loops():
    """Area means, the transform and the median by their definitions, bit by bit."""
    image = np.random.default_rng(5).integers(0, 256, (50, 70)).astype(np.uint8)
    height, width = image.shape
    cut = lambda n, k: range(k * n // 32, (k + 1) * n // 32)
    means = [[sum(int(image[y, x]) for y in cut(height, i) for x in cut(width, j)) / (len(cut(height, i)) * len(cut(width, j))) for j in range(32)] for i in range(32)]
    cos = lambda k, i: math.cos(math.pi * (2 * i + 1) * k / 64)
    low = [sum(means[i][j] * cos(u, i) * cos(v, j) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    assert media.cosine_hash(image) == f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_decode_of_foreign_ids(spark):
    """Ids without a token and bytes that are no whole ids are told in ``error``; the other rows are read."""
    path = P.path(byte_bpe.VOCABULARY)
    whole, far = np.asarray([0, 5, 7], "<u4").tobytes(), np.asarray([1, 4_000_000_000], "<u4").tobytes()
    rows = [(1, whole), (2, far), (3, b"abc"), (4, None), (5, b"")]
    got = {r.k: r for r in byte_bpe.decode_bpe(spark.createDataFrame(rows, "k int, ids binary"), path).collect()}
    assert (got[1].n_tokens, got[1].ids_text, got[1].error) == (3, "0 5 7", None) and len(got[1].decoded) >= 3
    assert (got[2].n_tokens, got[2].ids_text, got[2].decoded, got[2].error) == (None, None, None, "no token has id 4000000000")
    assert (got[3].decoded, got[3].error) == (None, "3 bytes are no whole ids")
    assert all((got[k].n_tokens, got[k].ids_text, got[k].decoded, got[k].error) == (0, "", b"", None) for k in (4, 5))


def test_chat_without_turns(spark):
    turns = spark.createDataFrame([(1, []), (2, None)], f"conv_id long, turns {chat._TURN}")
    got = {r.conv_id: (r.formatted, r.loss_spans) for r in chat.format_chat(turns).collect()}
    assert got == {1: ("", []), 2: (None, None)}


def test_pipeline_decisions(spark):
    """Each stage on what the one before kept: which documents go, which lines, and where pieces lie."""
    import corpus_pipeline as c

    stages, docs, labels = dict(c.STAGES), common.documents(spark, SF), common.labels(spark, SF)
    local = lambda df: spark.createDataFrame(df.collect(), df.schema)
    for name, module, kept in (("toxicity", toxicity, 0), ("quality", quality, 1)):
        score = toxicity.score_toxicity if name == "toxicity" else quality.score_quality
        low = {r.doc_id for r in score(docs, module.train(docs, labels)).filter(f"predicted = {kept}").collect()}
        before, docs = docs, local(stages[name](spark, docs, SF))
        bad = {r.doc_id for r in labels.filter("toxic = 1" if name == "toxicity" else "quality = 0").collect()}
        gone = {r.doc_id for r in before.collect()} - low
        assert {r.doc_id for r in docs.collect()} == low and len(gone) <= before.count() / 4 and 2 * len(gone & bad) >= len(gone & {r.doc_id for r in labels.collect()})
    rows = docs.collect()
    docs = local(stages["line_dedup"](spark, docs, SF))
    after = docs.collect()
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(((i, t) for i, t, *_ in kept_lines(rows)), key=str)
    assert all(r.n_chars == len(r.text) for r in after)
    docs = local(stages["ngram_join"](spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == {i for i, _, home in jaccard_components(after) if i == home}
    from tokenizers import Tokenizer

    t, places, of = Tokenizer.from_file(P.path(packing.VOCABULARY)), defaultdict(list), defaultdict(list)
    for r in stages["packing"](spark, docs, SF).collect():
        places[r.sequence_id].append((r.offset, r.length))
        of[r.doc_id].append((r.piece, r.start, r.length))
    for spans in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)])]
        assert [at for at, _ in sorted(spans)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert sorted(of.pop(r.doc_id)) == [(k, a, min(packing.CAPACITY, n - a)) for k, a in enumerate(range(0, n, packing.CAPACITY))]
    assert not of
