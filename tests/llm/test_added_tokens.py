"""Ids of op5 and op8 against an unmodified tokenizer, on texts that hold added tokens' strings."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import packing, pretoken, token_files

TEXTS = ["hi <|endoftext|> x", "<|startoftext|>a b<|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|>" * 3, "a <|endoftext| > b", "é <|endoftext|>  it's", "日 <|endoftext|> x", "plain text", ""]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    ids = library(name)
    got = pretoken.library_encoder(P.path(name)).encode(TEXTS)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [ids(t) for t in TEXTS]


def test_files_and_packing(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = library(token_files.VOCABULARY)
    files = token_files.write_token_files(docs, P.path(token_files.VOCABULARY), str(tmp_path / "a"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, files).collect()}
    assert got == {i: [*ids(t), token_files.END] for i, t in enumerate(TEXTS)}
    ids = library(packing.VOCABULARY)
    for r in packing.pack_documents(docs, P.path(packing.VOCABULARY)).collect():
        want = np.asarray([*ids(TEXTS[r.doc_id]), packing.END], "<u4")
        assert (r.length, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
