"""Byte-level BPE: overlapping chunk encoding, and decoding.

A text is cut into chunks that overlap.  Each chunk is split into pre-tokens on its own, so chunks of one long
text are spread over tasks.  Where a chunk starts is arbitrary, so its first pre-tokens may be wrong; but a match
of the pattern depends only on what follows its start, so from the first boundary that two neighbours share, both
agree.  ``_stitch`` finds that boundary in each overlap; each chunk then encodes exactly the pre-tokens from one
shared boundary to the next, with the text beyond as context.  A text in which some overlap has no shared boundary
(one pre-token longer than the overlap) is joined again and encoded in one piece: exact, and rare.

Texts of one chunk need no neighbour and are encoded where they lie, without a shuffle.

Null text counts as empty and gives no ids.  Repeated rows give repeated rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Characters of a chunk, and of what it shares with the next.
CHUNK = 1 << 16
OVERLAP = 1 << 11
#: A match may look at this many characters from its start although it ends before ('re, 've, 'll).
LOOK = 3
#: Pre-tokens whose ids a worker keeps; then it starts anew.
KEPT = 300_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One vocabulary with one pattern: pre-tokens, their ids, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}
        self.classes = self._classes()

    def _classes(self) -> np.ndarray:
        """The pattern library's own idea of letters, numbers and white space: it is asked for all of them."""
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            some = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
            found = some.decode_bytes(some.encode_ordinary(every)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
        return table

    def starts(self, text: str) -> np.ndarray:
        """Where the pre-tokens of ``text`` start, for the pattern of contractions, words, numbers, signs and white space.

        Runs of a class are pre-tokens; one space before a run belongs to it; the last character of white space
        before something else stands alone unless it is that space; contractions start where no run of signs does.
        """
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(code) == 0:
            return np.empty(0, np.int64)
        kind = self.classes[code]
        space = kind == _SPACE
        new = np.empty(len(code), bool)
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        lone = np.flatnonzero(space[:-1] & ~space[1:])
        new[lone] = True
        new[lone[code[lone] == 32] + 1] = False
        for p in np.flatnonzero(code == 39).tolist():
            if p and (kind[p - 1] == _OTHER or code[p - 1] == 32):
                continue
            for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
                if text.startswith(tail, p + 1):
                    new[p + 1] = False
                    if p + 1 + len(tail) < len(code):
                        q = p + 1 + len(tail)
                        if not (space[q - 1] or code[q - 1] == 32):
                            new[q] = True
                    break
        return np.flatnonzero(new)

    def piece(self, piece: str) -> bytes:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        ids = np.array(self.enc._encode_single_piece(piece), np.int32).tobytes()
        if len(piece) <= 64:
            self.kept[piece] = ids
        return ids

    def ids(self, text: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of the pre-tokens that start in [begin, end); ``begin`` is a boundary, what follows ``end`` context."""
        text, end = text[begin:], len(text) - begin if end is None else end - begin
        at = self.starts(text)
        stop = np.append(at[1:], len(text))
        use = at < end
        known, out = self.kept.get, []
        for a, b in zip(at[use].tolist(), stop[use].tolist(), strict=True):
            piece = text[a:b]
            out.append(known(piece) or self.piece(piece))
        return np.frombuffer(b"".join(out), np.int32)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32), pa.int32()))


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _encode_whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [use.ids(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                text = text.as_py()
                for i, at in enumerate(range(0, len(text), chunk)):
                    row = {"key": key.as_py(), "chunk": i, "body": text[at : at + chunk], "look": text[at + chunk : at + chunk + overlap]}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("body", pa.string()), ("look", pa.string())]))

    return run


def _mark(path: str, pattern: str, overlap: int):
    """Of each chunk: boundaries in the overlap with the chunk before, and trusted ones in that with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            rows = []
            for key, chunk, body, look in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = body + look
                at = use.starts(text)
                sure = at[1:][at[:-1] + LOOK <= len(text)]
                rows.append({"key": key, "chunk": chunk, "size": len(body), "head": at[at < overlap].tolist(), "tail": (sure[sure >= len(body)] - len(body)).tolist() if look else []})
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("size", pa.int32()), ("head", kind), ("tail", kind)]))

    return run


def _stitch(marks: pa.Table) -> pa.Table:
    rows = sorted(marks.to_pylist(), key=lambda r: r["chunk"])
    cuts = [0]
    for a, b in zip(rows, rows[1:], strict=False):
        shared = set(a["tail"]).intersection(b["head"])
        if not shared:
            cuts = None
            break
        cuts.append(min(shared))
    out = []
    for i, r in enumerate(rows):
        if cuts is None:
            out.append({"key": r["key"], "chunk": r["chunk"], "part": 0, "begin": 0, "beyond": 0})
        else:
            out.append({"key": r["key"], "chunk": r["chunk"], "part": i, "begin": cuts[i], "beyond": cuts[i + 1] if i + 1 < len(rows) else 0})
    ints = [(c, pa.int32()) for c in ("chunk", "part", "begin", "beyond")]
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), *ints]))


def _encode_parts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for key, part, body, look, begin, beyond in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = use.ids(body + look, begin, len(body) + beyond)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), _lists([ids])], ["key", "part", "ids"])

    return run


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text, each match of ``pattern`` encoded by itself."""
    from public_tokenizers import PATTERN

    if pattern != PATTERN:
        raise ValueError("pre-tokens are found by the rule of public_tokenizers.PATTERN")
    if not 0 < overlap <= chunk:
        raise ValueError("0 < overlap <= chunk")
    docs = texts_of(df, id_col, text_col)
    long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    whole = docs.where(~long).mapInArrow(_encode_whole(ranks_path, pattern), "doc_id long, ids array<int>")
    keyed = docs.where(long).withColumn("key", F.sha2("text", 256))
    chunks = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(_cut(chunk, overlap), "key string, chunk int, body string, look string").repartition("key", "chunk")
    marks = chunks.mapInArrow(_mark(ranks_path, pattern, overlap), "key string, chunk int, size int, head array<int>, tail array<int>")
    spans = marks.groupBy("key").applyInArrow(_stitch, "key string, chunk int, part int, begin int, beyond int")
    parts = chunks.join(spans, ["key", "chunk"]).groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("chunk", "body", "look"))).alias("c"), F.min("begin").alias("begin"), F.max("beyond").alias("beyond"))
    parts = parts.select("key", "part", F.array_join("c.body", "").alias("body"), F.element_at("c", -1)["look"].alias("look"), "begin", "beyond")
    made = parts.mapInArrow(_encode_parts(ranks_path, pattern), "key string, part int, ids array<int>")
    made = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p")).select("key", F.flatten("p.ids").alias("ids"))
    return whole.unionByName(keyed.select("doc_id", "key").join(made, "key").select("doc_id", "ids"))


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                made = [use.enc.decode_bytes(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(made, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary): the ids' bytes, one after the other.  Null ids give no bytes."""
    return df.select("doc_id", "ids").mapInArrow(_decode(ranks_path, pattern), "doc_id long, ids array<int>, decoded binary")


def ids_text(ids: str | Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"))
