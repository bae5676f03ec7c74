"""BPE against the tokenizers library, and back."""

import gc
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordflow.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "aaaaaaaaaaaaaaaa" * 30,
       " " * 200, "I'll we've it's", "漢字 かな ²³ Ⅷ ९", "é\u0301\u200b\x1c\x85\u3000x", "😀😀 <|endof",
       "x" * 5000, "word " * 4000, None, "a", "a"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(FILE)


def _texts(n=3000):
    rnd = random.Random(5)
    chars = ["the", "ing", " ", " ", "\n", "a", "Q", "é", "漢", "0", "९", "'s", "\t", "<|endoftext|>", "."]
    return ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_encode_and_decode_agree_with_the_library(make_docs, reference):
    texts = ODD + _texts()
    docs = make_docs(list(enumerate(texts)), ids="old", decoded="old", source="s")
    coded = bpe.decode(bpe.encode(docs, FILE), FILE).withColumn("sha", bpe.ids_digest("ids"))
    assert {"doc_id", "text", "ids", "decoded", "source", "sha"} == set(coded.columns)
    for r in coded.collect():
        ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)
        assert r.sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_round_trip_is_encode_and_decode(make_docs):
    docs = make_docs(list(enumerate(ODD + _texts(200))), _coded="old")
    one = {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(docs, FILE).collect()}
    two = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs, FILE), FILE).collect()}
    assert one == two and len(one) == len(ODD) + 200


def test_decode_odd_ids(spark, reference):
    # Half a character, and the two bytes of one in the wrong order.
    halves = [reference.encode("漢", add_special_tokens=False).ids[:1], [50256], [], None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(halves)], "i int, ids array<int>")
    got = {r.i: r.decoded for r in bpe.decode(df, FILE).collect()}
    assert got == {i: reference.decode(h or [], skip_special_tokens=False)
                   for i, h in enumerate(halves)}


def test_empty_table(make_docs):
    assert bpe.decode(bpe.encode(make_docs([]), FILE), FILE).count() == 0


def test_store_shrinks(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 60)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 50)
    store = bpe._Store(bpe.vocabulary(FILE))
    texts = _texts(400) + ODD[:-3]
    for got, text in zip(store.encode(texts), texts):
        assert got.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_merging_short_and_long_words_alike(monkeypatch):
    vocabulary = bpe.vocabulary(FILE)
    words = [w.encode() for t in _texts(300) for w in bpe.SPLIT.findall(t)]
    short = [vocabulary.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert [vocabulary.merge(w) for w in words] == short
    assert vocabulary.encode_words(words)[0] == short


def test_workers_keep_nothing_of_a_task(make_docs):
    docs = make_docs(list(enumerate(_texts(50)))).repartition(4)

    @F.arrow_udf("int")
    def kept(ids: pa.Array) -> pa.Array:
        held = sum(type(o).__module__ == "recordflow.llm.bpe" and not isinstance(o, type)
                   for o in gc.get_objects())
        return pa.array([held] * len(ids), pa.int32())

    for coded in (bpe.round_trip(docs, FILE), bpe.decode(bpe.encode(docs, FILE), FILE)):
        assert len(coded.collect()) == 50
        assert {r.n for r in docs.select(kept("doc_id").alias("n")).collect()} == {0}
