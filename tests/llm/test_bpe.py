import random

import pytest
from public_tokenizers import PATTERN, path

from panelspark.llm.bpe import bpe_decode, bpe_encode, codec

RANKS = path("byte_bpe_multi_50k.tiktoken")


def pieces(seed, n, most):
    random.seed(seed)
    alphabet = ["a", "bc", "'s", "'re", "'", " ", "  ", "\n", "\t", "12", "!", "é", "ß", "中", " ", "　", "́", "😀", "don't", " 's", "\r\n", "٣"]
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, most))) for _ in range(n)]


def test_pretokens_equal_the_library():
    use = codec(RANKS, PATTERN)
    for text in pieces(1, 3000, 14):
        assert use.ids(text).tolist() == use.enc.encode_ordinary(text)


def test_chunks_stitch_to_the_whole(spark):
    texts = [None, "", *pieces(2, 40, 200), "x" * 500, " " * 300 + "a", "word " * 60 + "y" * 90 + " tail", "same", "same", pieces(2, 1, 200)[0]]
    rows = [(i % 40, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, key int")
    use = codec(RANKS, PATTERN)
    want = sorted((i % 40, use.enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    for chunk, overlap in ((20, 16), (50, 25), (1 << 16, 1 << 11)):
        got = bpe_decode(bpe_encode(df, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS, PATTERN).collect()
        assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == want


def test_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(df, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(df, RANKS, r"\w+")
    with pytest.raises(ValueError):
        bpe_encode(df.drop("text"), RANKS, PATTERN)


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe_decode(df, RANKS, PATTERN).first().decoded) == b""
