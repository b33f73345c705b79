import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from panelspark.llm import media as module
from panelspark.llm.media import cosine_hash, decode_png, encode_media, encode_png, media_features, pad
from panelspark.llm.queries import op10_media_columns


def by_the_book(lines, bpp):
    """Undoes row filters byte by byte, as the format describes them."""
    out = []
    for y, (kind, *row) in enumerate(lines.tolist()):
        made = []
        for x, v in enumerate(row):
            a = made[x - bpp] if x >= bpp else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - bpp] if y and x >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            made.append((v + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(made)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("kinds", [(0, 1, 2), (0, 1, 2, 3, 4), (3,), (4,)])
def test_unfilter_equals_the_format(kinds):
    rng = np.random.default_rng(len(kinds))
    for height in (1, 2, 9, 70):
        lines = rng.integers(0, 256, (height, 25), np.uint8)
        lines[:, 0] = rng.choice(kinds, height)
        assert (module._unfilter(lines, 3) == by_the_book(lines, 3)).all()
    with pytest.raises(ValueError):
        module._unfilter(np.full((1, 4), 5, np.uint8), 3)


@pytest.mark.parametrize("kind", [None, 0, 1, 2, 3, 4])
def test_round_trip(kind):
    random.seed(1)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = pad(random.randbytes(n))
        assert len(payload) % 192 == 0 and len(payload) >= 192
        assert decode_png(encode_png(payload, kind)).tobytes() == payload
    with pytest.raises(ValueError):
        encode_png(b"short")


def test_written_rows_are_filtered():
    media = encode_png(pad(("some words of a text " * 60).encode()))
    n = int.from_bytes(media[33:37], "big")
    lines = np.frombuffer(zlib.decompress(media[41 : 41 + n]), np.uint8).reshape(-1, 193)
    assert set(lines[:, 0].tolist()) <= {0, 1, 2} and lines[:, 0].any()


def test_damage_is_found():
    media = encode_png(pad(b"text"))
    assert decode_png(media).shape == (1, 64, 3)
    for i in range(len(media)):
        with pytest.raises(ValueError):
            decode_png(media[:i] + bytes([media[i] ^ 1]) + media[i + 1 :])
        with pytest.raises(ValueError):
            decode_png(media[:i])


def test_cosine_hash_equals_its_definition():
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (5, 64, 3), np.uint8)
    luma = (samples.astype(int) * [77, 150, 29]).sum(axis=2) // 256
    low = [[sum(luma[y, x] * np.cos(np.pi * u * (2 * y + 1) / 10) * np.cos(np.pi * v * (2 * x + 1) / 128) for y in range(5) for x in range(64)) for v in range(8)] for u in range(8)]
    flat = np.round(np.array(low).ravel(), 6)
    bits = [False, *(flat[1:] > np.median(flat[1:]))]
    assert cosine_hash(samples) == np.packbits(bits).tobytes()


def test_query_against_brute_force(spark, tmp_path):
    random.seed(2)
    texts = [None, "", "a", "x" * 192, "é" * 97, "same", "same", "".join(random.choices("abc \n", k=300_000))]
    rows = [(i, t, b"clash", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media binary, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha256(stored).hexdigest())
        assert r.feature == cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)).hex()
    assert got[5].feature == got[6].feature


def test_null_media_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")
    assert [tuple(r) for r in media_features(df).collect()] == [(1, 2, None, None, None, None, None, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media_features(encode_media(empty)).count() == 0
