import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
WANT = Tokenizer.from_file(PATH)
OWN = bpe.ByteBpe(PATH)


def same(text):
    want = WANT.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(OWN.encode(text), "<i4").tolist()
    assert got == want, text[:100]
    assert OWN.decode(got) == WANT.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b \n\n c\t\td \n", "it's they'll I'D 'S", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "naïve Ünïcode 人工智能 🙂🙃", "x" * 5000, "ab" * 3000 + "　\x85\xa0q\x1c\x1d y", "1234567890 ²½ ٣", "\t\tx", "\r\n \r\n z", "a  b", "\x00\x01", "!!!???...---" * 50])
def test_equals_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r'stldvearZé½٣人🙂　\x85\xa0\x1c.,<|>endoftext_-0")), max_size=60))
def test_equals_the_library_on_odd_texts(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library_on_any_text(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 50300), max_size=30))
def test_decoding_any_ids(ids):
    assert OWN.decode(ids) == WANT.decode([i for i in ids if 0 <= i <= 50256], skip_special_tokens=False)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe.round_trip(docs).collect():
        ids = WANT.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "u"), (None, "", "v"), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, ids string")
    rows = bpe.encode(docs)
    assert rows.columns == ["doc_id", "text", "ids"]
    assert sorted(len(r.ids) for r in rows.collect()) == [0, 0, 2, 2]
    assert sorted(r.text for r in bpe.decode(rows).collect()) == ["", "", "a b", "a b"]
    assert bpe.round_trip(docs.limit(0)).count() == 0
