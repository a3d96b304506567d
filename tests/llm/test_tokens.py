import random

import pytest
from rideloom.llm import tokens as T

PATH = T.vocabulary()
TEXTS = ["", "a", "Hello  world \n\n x", "it's we'll I'D", "   lead", "trail   ", "<|endoftext|> in text", "emoji 👨‍👩‍👧 ünïcode é", "日本語 のテキスト", "tab\tand\r\nlines", "x" * 3000, "word " * 2000, "\x1c\x1d odd \x85 spaces　here"]


def reference(text):
    """Another library's implementation of the same vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_as_another_library_and_back(text):
    ids = T.encode(text, PATH)
    assert ids == reference(text)
    assert T.decode(ids, PATH) == text.encode()


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_pieces_change_nothing(size):
    rng = random.Random(size)
    for text in [*TEXTS, *("".join(rng.choice("ab 1.\n\t'sé👍  ") for _ in range(400)) for _ in range(30))]:
        assert "".join(T.pieces(text, size)) == text
        assert T.encode(text, PATH, size) == T.encode(text, PATH)


def test_tables(spark, small):
    schema = "doc_id long, text string, ids string, tokens int"
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "Hello world", "x", 1), (3, "Hello world", "x", 1)], schema)
    assert sorted((r.doc_id, r.ids) for r in T.token_ids(df).collect()) == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert sorted((r.doc_id, r.tokens) for r in T.token_counts(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert T.token_ids(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    back = {r.doc_id: r.text for r in T.decoded(T.token_ids(docs)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
