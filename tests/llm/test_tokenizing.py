from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import tokenizing as T

TEXTS = {
    1: None, 2: "", 3: "  ", 4: "Hello, world's  end\n\n\n x", 5: "naïve 漢字 👍🏽 é <|endoftext|> ​\x0c" * 40,
    6: "word " * 900, 7: "a" * 3000, 8: "   " * 500 + "x", 9: ("lorem ipsum " * 30 + "a" * 700) * 3, 10: "\r\n".join(f"line {i}, it's {i * 7}" for i in range(400)),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_ids_equal_those_of_whole_texts(docs):
    """Windows far smaller than in production, so that nearly every text is stitched."""
    enc = T.encoder(T.vocabulary_path())
    for spread in (256, 700, 1 << 20):
        got = {r.doc_id: list(r.ids) for r in T.encode(docs, "doc_id", "text", window=128, overlap=64, spread=spread).collect()}
        assert got == {k: (enc.encode_ordinary(t) if t else []) for k, t in TEXTS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 1'st\n.é漢\t"), max_size=400), st.integers(1, 40), st.integers(0, 12))
def test_stitches_are_boundaries_of_the_whole_text(text, window, overlap):
    cuts = T.stitches(text, window, overlap)
    assert set(cuts) <= {0, *accumulate(map(len, T._pattern().findall(text)))} and cuts == sorted(cuts) and cuts[-1] == len(text)
    enc = T.encoder(T.vocabulary_path())
    assert T.encode_text(enc, text, window, overlap) == enc.encode_ordinary(text)


def test_ordinary_texts_are_stitched():
    assert len(T.stitches("It's an ordinary text of a few words. " * 200)) > 3
    assert T.stitches("a" * 9_000) == [0, 9_000]


def test_equal_to_the_other_library(docs):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in T.encode(docs, "doc_id", "text").collect()}
    for k, text in TEXTS.items():
        assert got[k] == (t.encode(text, add_special_tokens=False).ids if text else [])


def test_round_trip(docs):
    coded = T.encode(docs, "doc_id", "text", window=256, overlap=64, spread=1024)
    assert {r.doc_id: r.text for r in T.decode(coded, "doc_id").collect()} == {k: t or "" for k, t in TEXTS.items()}


def test_empty_table_and_null_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert T.encode(empty, "doc_id", "text").collect() == []
    nulls = spark.createDataFrame([(None, "abc"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in T.encode(nulls, "doc_id", "text").collect()) == [0, 1]


def test_null_and_repeated_keys_of_long_texts(spark):
    rows = [(None, TEXTS[6]), (None, TEXTS[10]), (1, TEXTS[6]), (1, TEXTS[9]), (1, TEXTS[9]), (1, "short"), (None, None)]
    enc = T.encoder(T.vocabulary_path())
    want = sorted((str(k), enc.encode_ordinary(t or "")) for k, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), list(r.ids)) for r in T.encode(df, "doc_id", "text", window=256, overlap=64, spread=512).collect()) == want
