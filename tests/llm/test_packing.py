import itertools
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from panelspark.llm import packing
from panelspark.llm.packing import best_fit_decreasing, lower_bound, pack, pieces
from panelspark.llm.wordpieces import word_pieces

TOKENIZER = path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Sequences of an optimal packing, by trying all."""
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity:
                go(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best


def test_bounds_and_best_fit_against_optimal():
    random.seed(4)
    for _ in range(60):
        x = np.array([random.randint(1, 20) for _ in range(random.randint(1, 8))])
        bins, offsets, fill = best_fit_decreasing(x, 20)
        assert lower_bound(x, 20) <= fewest(x.tolist(), 20) <= len(fill)
        for b in range(len(fill)):
            inside = sorted(zip(offsets[bins == b], x[bins == b], strict=True))
            assert [o for o, _ in inside] == [0, *itertools.accumulate(n for _, n in inside)][:-1]
            assert fill[b] == x[bins == b].sum() <= 20
    assert lower_bound(np.array([11] * 7), 20) == 7
    assert lower_bound(np.array([]), 20) == 0


def test_word_pieces_equal_the_library():
    use = word_pieces(TOKENIZER)
    random.seed(5)
    alphabet = ["a", "b", "S", "'s", "'", "é", "é", "́", "ä", "<|endoftext|>", " ", "  ", "\n", "\t", "　", "中", "12", "!", "İ", "ß", "\x1c", "\x00"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 12))) for _ in range(3000)] + ["x" * 300]
    want = use.tokenizer.encode_batch(texts, add_special_tokens=False)
    for got, w in zip(use.ids(texts), want, strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == w.ids


def test_pieces_cut_only_long_documents(spark):
    rows = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "one"), (4, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = sorted(tuple(r) for r in pieces(df, TOKENIZER, 1, 3).collect())
    use = word_pieces(TOKENIZER)
    want = []
    for doc, text in rows:
        ids = [*use.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 3)):
            some = np.array(ids[at : at + 3], np.uint32)
            want.append((doc, k, at, len(some), zlib.crc32(some.tobytes())))
    assert got == sorted(want)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_partitions_exchange_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 100)
    random.seed(6)
    lengths = [random.randint(1, 60) for _ in range(800)] + [100] * 5
    df = spark.createDataFrame([(i % 700, 0, n, f"x{i}") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, extra string")
    alone = check_packing(pack(df, 100, rounds=1).collect(), 100)
    got = pack(df, 100).collect()
    n = check_packing(got, 100)
    assert sorted((r.doc_id, r.length, r.extra) for r in got) == sorted((r.doc_id, r.length, r.extra) for r in df.collect())
    assert lower_bound(np.array(lengths), 100) <= n <= alone
    assert n <= 1.03 * lower_bound(np.array(lengths), 100)


def test_empty_and_bad_lengths(spark):
    df = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert pack(df, 10).count() == 0
    with pytest.raises(Exception, match="out of bounds"):
        pack(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), 10).count()
