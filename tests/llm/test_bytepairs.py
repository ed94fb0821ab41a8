"""Byte-level BPE against the library that the ranks were made for: chunks, stitches, nulls, junk, repeats."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from evidentia.llm import bytepairs

ALPHABET = "ab'srtlvmd dD  \n\t1é漢　\x1cć!?'"


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.read_ranks(public_tokenizers.path(bytepairs.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(60)]
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 11))) for _ in range(n))
    long_ = [prose(900), "x" * 3000, "".join(rng.choice(ALPHABET) for _ in range(5000)), "漢字" * 800, " " * 2500 + "a", prose(40) + "y" * 900 + " " + prose(200), "don't we'll " * 300, "'" * 1500 + "re"]
    return [*odd, *long_, None, "", " ", "\n\n", "'s", "<|endoftext|>", "a\U00016ea7a \U00011de0" + "1", odd[0]]


def as_library(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def digested(docs, vocabulary, *cut):
    return bytepairs.digests(*(bytepairs.decode(p, vocabulary) for p in bytepairs.encode(docs, vocabulary, *cut)))


@pytest.mark.parametrize("chunk,overlap", [(bytepairs.CHUNK, bytepairs.OVERLAP), (96, 32), (40, 9)])
def test_ids_are_the_librarys_however_texts_are_cut(spark, library, texts, chunk, overlap):
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, texts[3])], "doc_id long, text string").selectExpr("doc_id", "text", "7 AS row", "'x' AS ids").repartition(3)
    vocabulary = bytepairs.Vocabulary(spark)
    got = digested(docs, vocabulary, chunk, overlap).collect()
    want = [(i, *as_library(library, t)) for i, t in [*enumerate(texts), (None, "no id"), (3, texts[3])]]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_parts_in_order_make_the_text(spark, texts):
    vocabulary = bytepairs.Vocabulary(spark)
    short, long_ = bytepairs.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary, 96, 32)
    parts = bytepairs.decode(short.unionByName(long_), vocabulary).collect()
    assert max(r.parts for r in parts) > 10
    for i, t in enumerate(texts):
        mine = sorted((r for r in parts if r.doc_id == i), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(mine[0].parts))
        assert b"".join(bytes(r.bytes) for r in mine) == (t or "").encode()


def test_heap_and_turns_merge_alike(ranks, library):
    rng = random.Random(9)
    coder = bytepairs.Coder(ranks, public_tokenizers.PATTERN)
    words = ["".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randrange(1, 80))).encode() for _ in range(400)] + [b"aaaaaaa", b"\xff\xfe", b"a"]
    turns = [np.frombuffer(x, "<u4").tolist() for x in coder.merged(words)]
    assert turns == [coder.by_heap(w) for w in words]
    letters = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 500))) for _ in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encoded([[w] for w in letters])] == [library.encode_ordinary(w) for w in letters]


def test_bytes_that_are_no_utf8_and_empty_tables(spark, library):
    vocabulary = bytepairs.Vocabulary(spark)
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    (row,) = digested(docs, vocabulary).collect()
    assert tuple(row)[1:] == as_library(library, "a�b")
    assert digested(docs.where("false"), vocabulary).count() == 0


def test_query_on_the_whole_table(spark, library):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    want = {r["doc_id"]: as_library(library, r["text"]) for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = bytepairs.op11_byte_bpe(spark, d).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
