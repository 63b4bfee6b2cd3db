"""Token operators against their libraries on whole texts, round trips, and the files and caches they keep."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runscope.llm import byte_bpe, token_binary, token_counts
from runscope.llm.elias_fano import EliasFano
from runscope.llm.pieces import PieceEncoder
from runscope.llm.queries import vocabulary_file
from tests.llm.edge import ROWS, edge_docs, empty_docs, key

TEXTS = [r[1] for r in ROWS]


@pytest.fixture(scope="module")
def byte_json():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_json():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    data = vocabulary_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aaeeiothnsrl  \n\t\r.,!?'0123<|>ÄßéñΣσς  　\x1c\x85́日🙂" + "AQ²Ⅷ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_count_tokens(spark, word_json, tmp_path):
    cache = str(tmp_path / "cache")
    docs = edge_docs(spark)
    expected = sorted([(r[0], len((r[1] or "").encode()),
                        len(word_json.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS], key=key)
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.count_tokens(docs, vocabulary_file("word_bpe_49k.json"), cache, limit=100).collect()
        assert sorted([tuple(r)[:3] for r in got], key=key) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
        kept = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
        assert kept.count() == kept.select("digest").distinct().count()
    assert token_counts.count_tokens(empty_docs(spark), vocabulary_file("word_bpe_49k.json")).collect() == []


def test_word_counter_on_random_texts(word_json):
    count = token_counts.WordCounter(vocabulary_file("word_bpe_49k.json"))
    for t in random_texts(3000):
        assert count(t) == len(word_json.encode(t, add_special_tokens=False).ids), repr(t)


def test_piece_encoder_on_random_texts(byte_json):
    encode, width = token_binary._encoder(vocabulary_file("byte_bpe_50k.json"))
    assert width == 2
    texts = random_texts(3000, 2)
    for t, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == byte_json.encode(t, add_special_tokens=False).ids, repr(t)


def test_piece_encoder_forgets_without_harm(monkeypatch):
    import runscope.llm.pieces as pieces

    monkeypatch.setattr(pieces, "GROUP_CHARS", 20)
    encode = PieceEncoder(lambda parts: [p.encode() for p in parts], lambda words: [b" " + w.encode() for w in words], 3)
    texts = ["a b c d e f", "f e d c b a", "a  b", " a", "x" * 100 + " y" + "z" * 100, "", "a\n", "a b"]
    assert encode(texts) == [t.encode() for t in texts]
    encode.forget()
    assert encode(texts) == [t.encode() for t in texts]


def test_token_documents(spark, byte_json):
    got = [tuple(r) for r in token_binary.token_documents(
        edge_docs(spark).repartition(5), vocabulary_file("byte_bpe_50k.json")).collect()]
    rows = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for doc_id, text in rows:
        ids = byte_json.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert token_binary.token_documents(empty_docs(spark), vocabulary_file("byte_bpe_50k.json")).collect() == []


def test_token_blocks_cut(spark, byte_json, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 50)
    got = token_binary.token_documents(edge_docs(spark), vocabulary_file("byte_bpe_50k.json")).collect()
    total = sum(len(byte_json.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS)
    last = max(got, key=lambda r: r["start"])
    assert last["start"] + last["n_tokens"] == total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 20), max_size=900), st.booleans())
def test_elias_fano(values, spread):
    values = sorted(v * (1 << 12) if spread else v % 50 for v in values)
    ef = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert ef.all().tolist() == values
    for i in range(0, len(values), 7):
        assert ef[i] == values[i]
    some = np.arange(3, len(values), 5)
    assert ef.at(some).tolist() == [values[i] for i in some]
    with pytest.raises(IndexError):
        ef.select(np.array([len(values)]))


def test_token_blocks_of_a_hot_id(spark, byte_json, tmp_path):
    """One doc_id on a third of the rows: several tasks write it; single documents are found by select."""
    rows = [(7 if i % 3 == 0 else i, f"text number {i % 40}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "blocks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task
    try:
        got = [tuple(r) for r in token_binary.token_documents(docs, vocabulary_file("byte_bpe_50k.json"), path=path)
               .orderBy("start").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ids = {t: [*byte_json.encode(t, add_special_tokens=False).ids, 2] for _, t in rows}
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert sorted((r[0], r[2]) for r in got) == sorted((d, len(ids[t])) for d, t in rows)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    blocks, _ = token_binary.read_token_blocks(spark, path)
    assert blocks.where("array_contains(doc_ids, 7)").count() > 1
    found = sorted((r[0], list(r[1])) for r in token_binary.look_up(blocks, [7, 11, 598, 5000]).collect())
    assert found == sorted((d, ids[t]) for d, t in rows if d in (7, 11, 598))


def test_counts_of_repeated_rows_are_encoded_once(spark, tmp_path, monkeypatch):
    rows = [(1, "same text"), (1, "same text"), (1, "same text"), (None, "null id"), (None, "null id"), (2, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    batches = token_counts.map_batches
    monkeypatch.setattr(token_counts, "map_batches", lambda df, *a: seen.append(df) or batches(df, *a))
    got = token_counts.count_tokens(docs, vocabulary_file("word_bpe_49k.json")).collect()
    assert len(got) == 6 and {r["n_tokens"] for r in got if r["doc_id"] == 1} == {2}
    assert sorted(r["text"] for r in seen[0].collect()) == ["null id", "own", "same text"]


def test_elias_fano_size():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 / len(ends) < 13  # 64 for a plain table


def test_elias_fano_rejects():
    with pytest.raises(ValueError):
        EliasFano.encode([3, 2])


def test_byte_bpe(spark, tik):
    got = byte_bpe.encode_decode(edge_docs(spark), vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                 ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    expected = []
    for r in ROWS:
        ids = tik.encode_ordinary(r[1] or "")
        data = (r[1] or "").encode()
        expected.append((r[0], ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), data,
                         hashlib.sha256(data).hexdigest()))
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4]), r[5]) for r in got], key=key) == sorted(expected, key=key)
    assert byte_bpe.encode_decode(empty_docs(spark), vocabulary_file("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_on_random_texts(tik):
    bpe = byte_bpe.ByteBpe(vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in random_texts(3000, 3):
        ids = bpe.encode(t).tolist()
        assert ids == tik.encode_ordinary(t), repr(t)
        assert bpe.decode(ids) == t.encode()


def test_byte_bpe_merges_as_the_ranks_say(tik):
    """The written model itself, without the look-up of whole pre-tokens."""
    import sentencepiece

    vocabulary = byte_bpe.load_ranks(vocabulary_file("byte_bpe_50k.tiktoken"))
    sp = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.sentencepiece_model(vocabulary))
    for word in (" reorganisations", "aaaaaaaaaaaaaaa", " überflüssig", "日本", "0000000", " ththththe"):
        assert sp.encode(byte_bpe.to_chars(word.encode())) == tik.encode_ordinary(word)


def test_load_ranks_rejects_gaps():
    with pytest.raises(ValueError):
        byte_bpe.load_ranks(b"YQ== 0\nYg== 2\n")
