"""Subword ids by merges over tables against the tokenizer's own."""

import pytest
from pyspark.sql import functions as F

from lamina import queries as q
from lamina.operators import subwords

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return subwords.Subwords.load(spark, PATH)


def test_like_the_tokenizer(spark, own, vocabulary):
    texts = [None, "", " \t\n", "The don't we'll 1234 (x)!?", "naïve café ÀÉ œuvre straße", "日本語 😀😀 ☃", "aaaaaaaaaaaaaaa " * 3, "x" * 300, "a b c", "'s's 'll''", "The don't we'll 1234 (x)!?", "pneumonoultramicroscopicsilicovolcanoconiosis"]
    d = spark.createDataFrame([(i, t, "p", [7]) for i, t in enumerate(texts)] + [(3, texts[3], "p", [7])], "i int, text string, piece string, ids array<int>")
    got = subwords.subword_ids(d, "text", vocabulary, "sub").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["sub"] == own.encode(texts[r["i"]] or "", add_special_tokens=False).ids and (r["piece"], r["ids"]) == ("p", [7])
    assert subwords.subword_ids(d.limit(0), "text", vocabulary).count() == 0


def test_conversations(spark, own):
    rows = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = q.QUERIES["retokenize_subwords"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = own.encode(rows[r["conv_id"], r["turn"]] or "", add_special_tokens=False).ids
        assert r["n"] == len(want) and r["xs"] == ",".join(map(str, (want + [0] * 256)[:256])) and r["ys"] == ",".join(map(str, (want + [-100] * 256)[:256]))


def test_bytes_have_names_of_their_own():
    names = subwords.byte_names()
    assert len(set(names)) == 256 and names[ord("a")] == "a" and names[32] == "Ġ" and not any(c.isspace() for c in names)


def test_unknown_symbols_are_errors(spark, vocabulary):
    poor = subwords.Subwords(vocabulary.vocabulary.where("token <> 'q</w>'"), vocabulary.merges, vocabulary.end)
    with pytest.raises(Exception, match="not in the vocabulary"):
        subwords.subword_ids(spark.createDataFrame([("q",)], "text string"), "text", poor).select(F.size("ids")).collect()


def test_merges_end_in_one_pass(spark, own, vocabulary, monkeypatch):
    """Only the rows' pieces are written, however long the chain of merges; merges that are many are joined, with the same ids."""
    written, real = [], subwords.cut
    monkeypatch.setattr(subwords, "cut", lambda df: written.append(1) or real(df))
    texts = ["internationalization aaaaaaaaaaaaaaaa", "naïve x" + "ab" * 90]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {t: own.encode(t, add_special_tokens=False).ids for t in texts}
    assert {r["text"]: r["ids"] for r in subwords.subword_ids(d, "text", vocabulary).collect()} == want and len(written) == 1
    monkeypatch.setattr(subwords, "MOST_BROADCAST", 10)
    assert {r["text"]: r["ids"] for r in subwords.subword_ids(d, "text", vocabulary).collect()} == want and len(written) > 2
