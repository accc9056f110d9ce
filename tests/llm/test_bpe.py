import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framewell.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "It's we'll  DON'T", "a<|endoftext|>b <|endo", " \n\n x　y 😀😀 aaaaaaaaaaaa ------ 123456\t", "été où l’œuvre", "a" * 5000, "the the the", "the the the", "漢字かな é́ ​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.encode(docs, PATH, decoded="decoded").collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_random_words_equal_the_library(library):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice(["a", "e", " ", "th", "ing", "é", "\n", "1", "'s", "ß", "漢", "--"]) for _ in range(30)) for _ in range(3000)]
    ids, starts = bpe.vocabulary(PATH).encode_batch(texts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[starts[k] : starts[k + 1]].tolist()


def test_decode_of_broken_ids(spark):
    rows = spark.createDataFrame([(1, [50256, 220, 999999]), (2, None), (3, [])], "doc_id int, token_ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, PATH).collect()}
    assert found == {1: "<|endoftext|> ", 2: "", 3: ""}


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hi", "x", 3)], "doc_id long, text string, token_ids string, n_tokens int")
    row = bpe.encode(docs, PATH).first()
    assert row["n_tokens"] == len(row["token_ids"]) > 0
    assert bpe.encode(docs.where("false"), PATH).count() == 0


def test_query_digests(spark, library, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op10_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_states_tell_all_tokens_that_end_at_a_prefix():
    made = bpe.vocabulary(PATH)
    for text in ("unbelievable  \u00e9\u4f60\U0001f600 12345", "aaaaaaaaaaaaaaaa\n\t--==", "internationalisation"):
        data, at = text.encode(), 0
        for end in range(1, len(data) + 1):
            at = made.back(at, data[end - 1])
            assert list(made.suffixes[at]) == [made.made[data[k:end]] for k in range(end) if data[k:end] in made.made]
