"""Counts against the tokenizer itself; the cache against a second run; normalising against plain counts."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import tokencounts

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = tokencounts.Vocabulary.load(PATH, spaces_drop=True, case_drops=True)
rng = random.Random(4)

TEXTS = [
    None, "", " \n", "Hello  World", "hello world", " HELLO\tWORLD\n", "it's they'RE <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "<| endoftext|>", "H̱ ẖ É É ß Σας ΣΑΣ",
    "a b c\x1fd\x85e", "≠ ≠", "日本語 テキスト 🙂🙂", "0123456789 12,345.67 ...!?", "x" * 5000, "\x00 \x01", "word, word. word; (word)", "İstanbul I",
]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(PATH)
    return lambda t: len(own.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def docs(spark):
    vocab = ["".join(rng.choices("abcdeéñZ", k=rng.randint(1, 9))) for _ in range(3000)]
    data = [*enumerate(TEXTS), (3, "Hello  World"), (None, "no id"), (None, None), (90, " ".join(rng.choices(vocab, k=400_000)))]
    data += [(100 + i, "one copy of many " * 20) for i in range(400)] + [(600 + i, " ".join(rng.choices(vocab, k=50))) for i in range(60)]
    return spark.createDataFrame(data, "doc_id long, text string").select("*", *[F.lit(3).alias(c) for c in ("id", "digest", "d", "rows", "content", "n_tokens")]).repartition(6)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("few", [0, 10_000])
def test_counts_and_cache(spark, docs, plain, few, tmp_path):
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := plain(r.text), n > 2048) for r in docs.collect()), key=str)
    cache = str(tmp_path / "cache")
    half = docs.where("doc_id % 2 = 0")
    tokencounts.count_tokens(half, WORDS, cache, broadcast_misses=few)
    stored = spark.read.parquet(cache)
    before = stored.count()
    assert before == stored.select("digest").distinct().count()
    assert result(tokencounts.count_tokens(docs, WORDS, cache, broadcast_misses=few, hot_rows=100)) == want
    stored = spark.read.parquet(cache)
    assert before < stored.count() == stored.select("digest").distinct().count()
    files = set(tmp_path.rglob("*.parquet"))
    assert result(tokencounts.count_tokens(docs, WORDS, cache)) == want
    assert files == set(tmp_path.rglob("*.parquet"))  # nothing was missing


def test_stored_counts_are_used_and_versions_kept_apart(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    one = docs.where("doc_id = 4")
    tokencounts.count_tokens(one, WORDS, cache)
    digest = spark.read.parquet(cache).first().digest
    marked = str(tmp_path / "marked")
    spark.createDataFrame([(digest, 77)], "digest binary, n_tokens long").write.parquet(f"{marked}/tokenizer={WORDS.version}")
    got = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(docs.where("doc_id < 6"), WORDS, marked).collect()}
    assert got[4] == got[5] == got[3] == 77 and got[1] == 0  # by case and white space the same content
    other = tokencounts.Vocabulary.load(PATH)
    assert other.version != WORDS.version
    assert {r.n_tokens for r in tokencounts.count_tokens(one, other, marked).collect()} == {2}


def test_empty_table_stores_nothing(spark, docs, tmp_path):
    assert tokencounts.count_tokens(docs.where("false"), WORDS, str(tmp_path / "c")).count() == 0
    assert not (tmp_path / "c").exists()


def test_other_libraries(spark, docs, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.where("doc_id < 17")
    got = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(some, tokencounts.Vocabulary.load(path), str(tmp_path / "c")).collect()}
    assert got == {i: len(own.encode(t or "")) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError):
        tokencounts.Vocabulary.load("x.tiktoken")


COUNT = tokencounts.counter(WORDS.content, "json", True, memo_words=50)
PIECES = st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n", "\t", "'S", "'re", "<|", "|>", "endoftext", "<|endoftext|>", "Σ", "́", "̸", "A", "é", "...", "=", "7"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_words_apart_and_normalised_content_count_the_same(plain, text):
    want = plain(text)
    assert COUNT(text) == want
    squeezed = " ".join(text.encode().split() and [w.decode() for w in text.encode().split()])
    assert plain(squeezed) == want
    if squeezed.isascii() and "<|" not in squeezed:
        assert plain(squeezed.lower()) == want


def test_normalised_column(spark):
    texts = ["  A \t\n b\x0b\x0c\rC ", "É A", "x<|A", None, " A ", "Kelvin K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokencounts.normalised(F.col("t"), True, True)).collect()]
    assert got == ["a b c", "É A", "x<|A", "", " A ", "Kelvin K"]
