"""Line deduplication: fuzzy lines by SimHash.

A line is normalised: letters lower-cased, digits made 0, ASCII signs and white space made single spaces.  Lines of at
least ``min_words`` words take part (all that aren't blank, by default); others always stay.

1. Equal normalised lines (64-bit hash of the words) are one line.
2. Candidates.  Blocks of a 64-bit SimHash can't find lines of edit similarity 0.8: such lines differ in some 18 bits,
   so that blocks by the pigeonhole principle would have three bits.  Blocks are therefore built of minima: lines meet
   where one of BANDS hashes of ROWS minima over their features is equal.  The features are pairs of neighbouring words;
   for lines of few words, or of very long ones, runs of bytes (see _classes).  The SimHash of the same features screens
   those that meet: it may differ in MOST bits.
3. Lines with 1 - edit distance / longer length >= ``similarity`` are linked; nothing else is.  Candidates are linked by
   stars, not pair by pair (see linking).  Members of a group that are apart from its pivot meet again on minima over
   the features that the pivot doesn't have, so that a passage that many lines hold makes no pairs.
4. Links are closed to groups; of each group's occurrences the first stays (smallest document, then line), all others go.

Recall of the candidates: see the README and the tests.  Only numbers and hashes of lines are shuffled, texts only of
lines that meet others and of documents that lose lines.

Null text stays null and has no lines.  Rows without a doc_id lose nothing and take part in nothing.  Rows that repeat
both doc_id and text are one document; rows that repeat the doc_id alone are ordered by a hash of the text.  Lines of
any length take part whole; an edit distance that a walk through both lines word by word doesn't settle takes time in
proportion to the square of what two lines don't start and end with alike, divided by the bits of a machine word.  All columns come back; n_lines, n_removed and
n_left (lines left that took part) replace columns of these names.  Names starting with ``__`` are reserved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, filter_of, in_filter, lean, need, slot_of, texts_of
from .linking import link_members
from .substrings import bloom_has, bloom_of
from .textscan import as_long, mix, slices, string_buffers

MIN_WORDS = 1
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
#: Bands of lines of few words, which one changed word changes most.
SHORT_BANDS = 24
#: Lines from WORDY words on meet by pairs of words, those of less than FEW by runs of bytes, those in between by both.
WORDY = 14
FEW = 18
#: Bytes a word up to which a line counts as one of words.
LONG_WORD = 20
#: Most bits in which SimHashes may differ: over pairs of words, over runs of bytes.
MOST = 27
MOST_SHORT = 29

#: Passes over the band keys, to have only a part of them in a shuffle at once.
PASSES = 2
#: Parts that band keys are dealt to by their first bits: a part is sorted at once.
PART_BITS = 12
#: Band keys that a task deals out at once, and rows of met lines that it gives back at once.
DEALT = 1 << 20
GIVEN = 1 << 16

#: Buckets that runs of characters are counted in to screen pairs of lines, and pairs counted side by side.
COUNTED = 1 << 12
BESIDE = 128

#: Runs of features up to which SimHashes are counted side by side.
SLICED = 255

_SEEDS = mix(np.arange(1, SHORT_BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1001, SHORT_BANDS * ROWS + 1001, dtype=np.uint64)).astype(np.uint32)
_BAND = mix(np.arange(5001, SHORT_BANDS + 5001, dtype=np.uint64))
_FACTORS = mix(np.arange(7001, 7017, dtype=np.uint64)) | np.uint64(1)

#: Odd multiplier of the hashes of words.
_ODD = 0xD1342543DE82EF95

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum() and c != 10]] = 32
_PLAIN[48:58] = 48
_PLAIN[65:91] += 32


def _lines(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(rows, normalised bytes, line offsets, row of each line, number of each line in its row); each line ends in a break."""
    for rows, raw, cuts in slices(batch, "text"):
        raw, cuts = raw.tobytes(), cuts.tolist()
        texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # the table lowers ASCII letters
        data = _PLAIN[np.frombuffer(b"\n".join([*(t if t.isascii() else t.decode().lower().encode() for t in texts), b""]), np.uint8)]
        # an empty text has one empty line; so has a text that ends in a break
        per = np.array([t.count(b"\n") + 1 for t in texts])
        row = np.repeat(np.arange(len(per)), per)
        number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        yield rows, data, np.append(0, np.flatnonzero(data == 10) + 1), row, number


def _plain_lines(data: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers, normalised bytes, hashes) of the lines with at least ``min_words`` words."""
    solid = data > 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    # each word and one space
    flat = np.maximum(data[keep], np.uint8(32))
    first = _first_words(solid, offs)
    bounds = np.append(0, np.flatnonzero(flat == 32) + 1)[first]
    use = np.flatnonzero(np.diff(first) >= max(min_words, 1))
    raw = flat.tobytes()
    lines = [raw[a:b] for a, b in zip(bounds[use].tolist(), (bounds[use + 1] - 1).tolist(), strict=True)]
    return use, lines, np.array([xxh3_64_intdigest(x) for x in lines], np.uint64)


def _first_words(solid: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words before each offset."""
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    return np.searchsorted(np.flatnonzero(begins), offs)


@lru_cache(maxsize=1)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2**64, and their inverses."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that end in one space each, and the words before each offset."""
    starts = np.append(0, np.flatnonzero(data == 32)[:-1] + 1)
    powers, inverses = _factors(max(1 << 21, 1 << len(data).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(data * powers[: len(data)], starts)
        return mix(sums * inverses[starts]), np.searchsorted(starts, offs)


def _sum3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of three digits in each bit: lower and upper digit."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def _majority(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each run of ``n`` hashes from ``first``."""
    sim = np.zeros(len(n), np.uint64)
    order = np.argsort(-n, kind="stable")
    long = int(np.searchsorted(-n[order], -SLICED, side="left"))
    for i in order[:long].tolist():
        bits = np.unpackbits(hashes[first[i] : first[i] + n[i]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sim[i] = np.packbits(bits.sum(axis=0) > n[i] // 2, bitorder="little").view("<u8")[0]
    order = order[long:]
    if not len(order):
        return sim
    # the k-th hashes of all runs at once are added to counters of 64 bits side by side, one plane for each binary digit
    start, size = first[order], n[order]
    planes = np.zeros((SLICED.bit_length(), len(order)), np.uint64)

    def add(carry: np.ndarray, digit: int, most: int) -> None:
        for plane in planes[digit : most.bit_length()]:
            here = plane[: len(carry)]
            carry, plane[: len(carry)] = here & carry, here ^ carry

    for k in range(0, int(size[0]) - 7, 8):
        # eight at once make one carry
        active = int(np.searchsorted(-size, -(k + 7), side="left"))
        at = start[:active] + k
        one, two, four = planes[:3, :active]
        halves = []
        for i in (0, 4):
            one, x = _sum3(one, hashes[at + i], hashes[at + i + 1])
            one, y = _sum3(one, hashes[at + i + 2], hashes[at + i + 3])
            two, z = _sum3(two, x, y)
            halves.append(z)
        planes[0, :active], planes[1, :active] = one, two
        planes[2, :active], carry = _sum3(four, *halves)
        add(carry, 3, k + 8)
    rest = np.argsort(-(size & 7), kind="stable")
    left = (size & 7)[rest]
    tails, planes = (start + (size & ~7))[rest], planes[:, rest]
    for k in range(int(left[0])):
        active = int(np.searchsorted(-left, -k, side="left"))
        add(hashes[tails[:active] + k], 0, SLICED)
    planes = planes[:, np.argsort(rest)]
    count = np.zeros((len(order), 64), np.int16)
    for j, plane in enumerate(planes):
        count += np.unpackbits(plane.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16) << j
    sim[order] = np.packbits(count > (size // 2)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return sim


def _keys(hashes: np.ndarray, start: np.ndarray, bands: int, salt: int) -> np.ndarray:
    """(lines, bands) hashes of ROWS minima over the features of each line."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            part = np.full(len(start), _BAND[b] + np.uint64(salt), np.uint64)
            for r in range(b * ROWS, (b + 1) * ROWS):
                part = mix(part + np.minimum.reduceat((small ^ _SHIFTS[r]) * _SEEDS[r], start))
            out[:, b] = part
    return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges of ``n`` from ``first``, one after the other, and where each range begins in them."""
    start = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - start, n), start


def _runs(flat: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, number) of the runs of ``length`` bytes of each line; a shorter line is one run."""
    n = np.maximum(size - length + 1, 1)
    at, start = _ranges(first, n)
    end = np.repeat(first + size, n)
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            inside = at + k < end
            total += np.where(inside, flat[np.minimum(at + k, len(flat) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _FACTORS[k]
    return mix(total), start, n


class Signed(NamedTuple):
    """Signatures of lines: characters, words, SimHash over pairs of words and over runs of bytes, band keys."""

    size: np.ndarray
    words: np.ndarray
    sim: np.ndarray
    short_sim: np.ndarray
    bands: pa.Array


def _classes(bytes_: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(which lines, bytes of a run) of lines that meet by runs of bytes; lines near a limit are in two classes."""
    few = (n < FEW) | (bytes_ > LONG_WORD * n)
    return [(few & (bytes_ < 40), 3), (few & (bytes_ >= 32) & (bytes_ < 125), 6), (few & (bytes_ >= 100), 12)]


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the runs of 64-bit ``values`` (or rows of them) that ``ends`` bounds, a binary value each."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(values)])


def signatures(lines: list[bytes]) -> Signed:
    """Signatures of normalised lines, none of them empty."""
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    offs = np.cumsum([0, *(len(x) + 1 for x in lines)])
    hashes, first = _word_hashes(data, offs)
    first, n = first[:-1], np.diff(first)
    chars = offs if data.max() < 128 else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    bytes_, size = np.diff(offs) - 1, np.diff(chars) - 1
    sim, short = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    whose, keys = [], []

    def add(lines: np.ndarray, made: np.ndarray) -> None:
        whose.append(np.repeat(lines, made.shape[1]))
        keys.append(made.ravel())

    wordy = np.flatnonzero((n >= WORDY) & (bytes_ <= LONG_WORD * n))
    if len(wordy):
        at, start = _ranges(first[wordy], n[wordy] - 1)
        with np.errstate(over="ignore"):
            pairs = mix(hashes[at] * _FACTORS[0] + hashes[at + 1])
        sim[wordy] = _majority(pairs, start, n[wordy] - 1)
        add(wordy, _keys(pairs, start, BANDS, 0))
    few = np.flatnonzero((n < FEW) | (bytes_ > LONG_WORD * n))
    if len(few):
        at, place = _ranges(offs[few], bytes_[few] + 1)
        flat = data[at]
        short[few] = _majority(*_runs(flat, place, bytes_[few], 3))
        for which, run in _classes(bytes_[few], n[few]):
            mine = np.flatnonzero(which)
            if len(mine):
                runs, start, _ = _runs(flat, place[mine], bytes_[few][mine], run)
                add(few[mine], _keys(runs, start, SHORT_BANDS if run < 12 else BANDS, run))
    owner = np.concatenate(whose)
    values = np.concatenate(keys)[np.argsort(owner, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))
    return Signed(size, n, sim, short, _packed(as_long(values), ends))


SIGNED = "doc_id long, key long, number int, line long, size int, words int, sim long, short_sim long, bands binary"


def _sign(min_words: int):
    """Every line that takes part; with its signature where this task meets its text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offs, row, number in _lines(batch):
                use, lines, hashes = _plain_lines(data, offs, min_words)
                if not len(use):
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                new = [i for i, h in enumerate(hashes.tolist()) if not (h in seen or seen.add(h))]
                filled = np.zeros(len(use), bool)
                filled[new] = True
                spread = pa.array(np.where(filled, np.cumsum(filled) - 1, 0), mask=~filled)
                owner = pa.array(row[use])
                columns = [rows.column("doc_id").take(owner), rows.column("key").take(owner), pa.array(number[use].astype(np.int32)), pa.array(as_long(hashes))]
                if new:
                    made = signatures([lines[i] for i in new])
                    signed = [pa.array(made.size.astype(np.int32)), pa.array(made.words.astype(np.int32)), pa.array(as_long(made.sim)), pa.array(as_long(made.short_sim)), made.bands]
                    columns += [c.take(spread) for c in signed]
                else:
                    columns += [pa.nulls(len(use), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "number", "line", "size", "words", "sim", "short_sim", "bands"])
        _factors.cache_clear()

    return run


def _deal(turn: int):
    """(part, block): the band keys of this turn with their lines, packed by the first bits of the keys."""

    def packed(lines: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.stack([np.concatenate(keys), np.concatenate(lines)], axis=1)
        part = (pairs[:, 0].view(np.uint64) >> np.uint64(64 - PART_BITS)).astype(np.uint16)
        count = np.bincount(part, minlength=1 << PART_BITS)
        there = np.flatnonzero(count)
        blocks = _packed(pairs[np.argsort(part, kind="stable")], np.append(0, np.cumsum(count[there])))
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), blocks], ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, keys, held = [], [], 0
        for batch in batches:
            data, offs = string_buffers(batch.column("bands"))
            key = data.view(np.int64)
            line = np.repeat(batch.column("line").to_numpy(), np.diff(offs) >> 3)
            mine = np.flatnonzero((key.view(np.uint64) >> np.uint64(64 - PART_BITS)) % np.uint64(PASSES) == turn)
            lines.append(line[mine])
            keys.append(key[mine])
            held += len(mine)
            if held >= DEALT:
                yield packed(lines, keys)
                lines, keys, held = [], [], 0
        if held:
            yield packed(lines, keys)

    return run


def _meeting(pairs: np.ndarray) -> np.ndarray:
    """(first, rep, n) of the buckets of (key, line) rows that hold several lines: smallest line, each line, rows of the largest such bucket."""
    pairs = pairs[np.argsort(pairs[:, 0])]
    same = pairs[1:, 0] == pairs[:-1, 0]
    pairs = pairs[np.append(same, False) | np.append(False, same)]
    if not len(pairs):
        return np.empty((0, 3), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    begins = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
    n = np.diff(np.append(begins, len(pairs)))
    first, last = pairs[begins, 1], pairs[begins + n - 1, 1]
    rows = np.stack([np.repeat(first, n), pairs[:, 1], np.repeat(n, n)], axis=1)[np.repeat(first != last, n)]
    # of the same line in several buckets of a first the largest counts
    rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, rep, n) of blocks that come in the order of their parts."""

    def given(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows).T.copy()], ["first", "rep", "n"])

    blocks = ((part, block) for batch in batches for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True))
    out, held = [], 0
    for _, some in groupby(blocks, key=itemgetter(0)):
        rows = _meeting(np.frombuffer(b"".join([block for _, block in some]), np.int64).reshape(-1, 2))
        out.append(rows)
        held += len(rows)
        if held >= GIVEN:
            yield given(out)
            out, held = [], 0
    if held:
        yield given(out)


def _texts(min_words: int, bloom):
    """Normalised texts of the lines that may be in the filter, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bloom.value, np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for _, data, offs, _, _ in _lines(batch):
                _, lines, hashes = _plain_lines(data, offs, min_words)
                if len(seen) > 1 << 20:
                    seen.clear()
                some = np.flatnonzero(bloom_has(table, hashes)).tolist()
                new = [i for i, h in zip(some, hashes[some].tolist(), strict=True) if not (h in seen or seen.add(h))]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(hashes[new])), pa.array([lines[i].decode() for i in new], pa.string())], ["line", "norm"])

    return run


def _common(a: str, b: str) -> int:
    """Length of what both start with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they start and end with alike."""
    i = _common(a, b)
    j = _common(a[i:][::-1], b[i:][::-1])
    return a[i : len(a) - j], b[i : len(b) - j]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance by bit vectors, one step for each character of the shorter; more than ``most`` may come out too small, but not as ``most`` or less."""
    a, b = sorted(_trimmed(a, b), key=len, reverse=True)
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    mask = (1 << len(a)) - 1
    plus, minus = mask, 0
    further = len(a) - len(b)
    for j, c in enumerate(b, 1):
        same = where.get(c, 0)
        across = ((same & plus) + plus ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~((same | minus) | up)) & mask, up & (same | minus) & mask
        if most is not None and not j & 31:
            # distances don't fall along the diagonal that ends where both lines end
            upper = (1 << j + further) - 1
            least = j + (plus & upper).bit_count() - (minus & upper).bit_count()
            if least > most:
                return least
    return len(b) + plus.bit_count() - minus.bit_count()


def _shared(a: str, b: str, run: int) -> int:
    """Runs of characters in common, counted as often as both have them; each edit changes ``run`` of them at most."""
    x, y = (Counter([t[i : i + run] for i in range(len(t) - run + 1)]) for t in (a, b))
    return sum(min(n, y[k]) for k, n in x.items() if k in y)


def _few_edits(a: str, b: str, most: int) -> bool:
    """Whether going through both word by word, with a look at the next words where they differ, takes ``most`` edits or less.

    Never says yes of lines that are further apart."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    m, n = len(x), len(y)
    while i < m and j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        if x[i + 1 : i + 2] == y[j + 1 : j + 2]:
            p = q = 1
        else:
            after = [(p + q, p, q) for p in range(4) for q in range(4) if p + q and x[i + p : i + p + 1] == y[j + q : j + q + 1]]
            _, p, q = min(after) if after else (0, 1, 1)
        u, v = " ".join(x[i : i + p]), " ".join(y[j : j + q])
        # without words on one side, their spaces go too
        cost += max(len(u), len(v)) if p and q else len(u) + len(v) + 1
        if cost > most:
            return False
        i, j = i + p, j + q
    rest = " ".join(x[i:]) + " ".join(y[j:])
    return cost + (len(rest) + 1 if i < m or j < n else 0) <= most


def near(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length >= ``similarity``."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if _few_edits(a, b, most):
        return True
    return all(_shared(a, b, run) >= longer - run + 1 - run * most for run in (3, 2)) and edit_distance(a, b, most) <= most


def _shared_all(pairs: list[tuple[str, str]], run: int) -> np.ndarray:
    """What _shared says of each pair, or more where different runs fall into one bucket."""
    out = np.empty(len(pairs), np.int64)
    for i in range(0, len(pairs), BESIDE):
        some = [t for pair in pairs[i : i + BESIDE] for t in pair]
        size = np.array([len(t) for t in some])
        codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        at, start = _ranges(np.cumsum(size) - size, np.maximum(size - run + 1, 0))
        mixed = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(run):
                mixed += codes[at + k] * _FACTORS[k]
        owner = np.repeat(np.arange(len(some)), np.maximum(size - run + 1, 0))
        slot = (mixed >> np.uint64(40)).astype(np.int64) & (COUNTED - 1)
        count = np.bincount(owner * COUNTED + slot, minlength=len(some) * COUNTED).reshape(-1, 2, COUNTED)
        out[i : i + BESIDE] = np.minimum(count[:, 0], count[:, 1]).sum(axis=1)
    return out


def near_all(pairs: list[tuple[str, str]], similarity: float) -> list[bool]:
    """What near() says of each pair; lines that aren't long are screened side by side."""
    keep = [False] * len(pairs)
    open_ = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int(longer * (1 - similarity) + 1e-9)
        if longer > COUNTED:
            keep[i] = near(a, b, similarity)
        elif abs(len(a) - len(b)) <= most:
            keep[i] = _few_edits(a, b, most)
            if not keep[i]:
                open_.append((i, longer, most))
    for run in (3, 2):
        shared = _shared_all([pairs[i] for i, _, _ in open_], run).tolist()
        open_ = [x for x, n in zip(open_, shared, strict=True) if n >= x[1] - run + 1 - run * x[2]]
    for i, _, most in open_:
        keep[i] = edit_distance(*pairs[i], most) <= most
    return keep


def _near(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = near_all(list(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _features(line: str) -> set[str]:
    w = line.split(" ")
    return {f"{p} {q}" for p, q in zip(w, w[1:], strict=False)} if len(w) >= WORDY else {line[i : i + 4] for i in range(max(1, len(line) - 3))}


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of two minima each over the features of a line that its pivot doesn't have."""
    bands = 6
    last, pivot = None, set()
    for batch in batches:
        hashes, n = [], []
        for x, p in zip(batch.column("norm").to_pylist(), batch.column("np").to_pylist(), strict=True):
            if p != last:
                # the rows of a pivot mostly come one after the other
                last, pivot = p, _features(p)
            own = _features(x) - pivot
            hashes += [crc32(f.encode()) for f in own]
            n.append(len(own))
        n = np.array(n, np.int64)
        some = np.flatnonzero(n)
        ends = np.append(0, np.cumsum(np.where(n > 0, bands, 0)))
        keys = np.empty((len(some), bands), np.uint64)
        if len(some):
            h, start = np.array(hashes, np.uint32), (np.cumsum(n) - n)[some]
            with np.errstate(over="ignore"):
                for k in range(bands):
                    one, two = (np.minimum.reduceat((h ^ _SHIFTS[r]) * _SEEDS[r], start).astype(np.uint64) for r in (2 * k, 2 * k + 1))
                    keys[:, k] = mix(mix(_BAND[k] + one) + two)
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(as_long(keys.ravel())))
        kept = [c for c in batch.schema.names if c not in {"norm", "np"}]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, "keys"])


def line_groups(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key, gone (numbers of lines to remove) of (doc_id, key, text) rows that lose lines."""
    sc = docs.sparkSession.sparkContext
    usable = docs.where("doc_id is not null and text is not null")
    signed = scratch.save(usable.mapInArrow(lean(_sign(min_words)), SIGNED), "signed")
    lines = signed.groupBy("line").agg(F.min(F.struct("doc_id", "key", "number")).alias("first"), F.max(F.struct("doc_id", "key", "number")).alias("last"))
    repeated = lines.where("first <> last")

    # several tasks may have signed the same line: it is in a bucket more than once, and bands have one line each then
    rows = signed.where("bands is not null").select("line", "bands")
    met = []
    for i in range(PASSES):
        # a bucket is in one part, and so in one pass, whole; the shuffle of a pass is freed before the next
        dealt = rows.mapInArrow(lean(_deal(i)), "part int, block binary").repartition("part").sortWithinPartitions("part")
        met.append(scratch.save(dealt.mapInArrow(lean(_meet), "first long, rep long, n long"), f"met{i}"))
        scratch.collect()
    members = scratch.save(reduce(DataFrame.unionByName, met).groupBy("first", "rep").agg(F.max("n").alias("n")), "members")
    scratch.drop(*(f"met{i}" for i in range(PASSES)))
    mine = scratch.save(members.select("rep").distinct(), "mine")
    features = signed.where("bands is not null").select(F.col("line").alias("rep"), F.struct("size", "words", "sim", "short_sim").alias("feature"))
    features = scratch.save(features.join(mine, "rep", "left_semi").dropDuplicates(["rep"]), "features")
    bloom = sc.broadcast(bloom_of(mine, max(1 << 16, mine.count())))
    norms = usable.select("doc_id", "text").mapInArrow(lean(_texts(min_words, bloom)), "line long, norm string").dropDuplicates(["line"])
    norms = scratch.save(norms, "norms")

    def close(a: Column, b: Column) -> Column:
        sized = F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * similarity - 1e-6
        by_words = (a["sim"] != 0) & (b["sim"] != 0)
        bits = F.when(by_words, F.bit_count(a["sim"].bitwiseXOR(b["sim"])) <= MOST).otherwise(F.bit_count(a["short_sim"].bitwiseXOR(b["short_sim"])) <= MOST_SHORT)
        return sized & bits

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = norms.select(F.col("line").alias("a"), F.col("norm").alias("na"))
        b = norms.select(F.col("line").alias("b"), F.col("norm").alias("nb"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb").mapInArrow(lean(_near(similarity)), "a long, b long")

    def residue(groups: DataFrame) -> DataFrame:
        own = norms.select(F.col("line").alias("rep"), "norm")
        pivots = norms.select(F.col("line").alias("pivot"), F.col("norm").alias("np"))
        both = groups.join(own, "rep").join(pivots, "pivot").select("pivot", "rep", "of_rep", "apart", "norm", "np")
        keyed = scratch.save(both.mapInArrow(lean(_apart), "pivot long, rep long, of_rep long, apart boolean, keys array<long>"), "apart")
        keyed = keyed.select("pivot", "rep", "of_rep", "apart", F.explode("keys").alias("band"))
        # stars again: among the members that share a key with one that is apart
        bucket = Window.partitionBy("pivot", "band")
        star = keyed.withColumns({"some": F.max("apart").over(bucket), "a": F.min("rep").over(bucket), "of_a": F.min_by("of_rep", "rep").over(bucket)})
        return star.where("some and a <> rep and of_a <> of_rep").select("a", F.col("rep").alias("b"))

    found = link_members(members, features, close, confirmed, residue, scratch)
    if found is None:
        groups = repeated.select("line", F.col("first").alias("stays"))
    else:
        named = lines.join(found.withColumnRenamed("node", "line"), "line", "left").where("first <> last or component is not null")
        named = scratch.save(named.select("line", "first", "component"), "named")
        stays = named.where("component is not null").groupBy("component").agg(F.min("first").alias("stays"))
        groups = named.join(stays, "component", "left").select("line", F.coalesce("stays", "first").alias("stays"))
    lost = signed.select("doc_id", "key", "number", "line").join(groups, "line").where(F.struct("doc_id", "key", "number") != F.col("stays"))
    return scratch.finish(lost.groupBy("doc_id", "key").agg(F.collect_set("number").alias("gone")), "lost")


def _counts(data: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and how many of them have ``min_words`` words; lower case changes neither."""
    plain = _PLAIN[data]
    breaks = np.flatnonzero(plain == 10)
    solid = plain > 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offs[:-1][offs[1:] > offs[:-1]]
    begins[first] = solid[first]
    per = np.diff(np.searchsorted(breaks, offs)) + 1
    # each text's lines end where its breaks are and where it ends
    row = np.repeat(np.arange(len(per)), per)
    bounds = np.sort(np.concatenate([breaks, offs[1:]]), kind="stable")
    words = np.diff(np.append(0, np.searchsorted(np.flatnonzero(begins), bounds)))
    return per, np.bincount(row[words >= min_words], minlength=len(per))


def _apply(min_words: int):
    """Takes the lines ``__gone`` out of ``__text`` and counts lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column("__text")
            there = plain.is_valid().to_numpy(zero_copy_only=False)
            parts = [_counts(data, offs, min_words) for _, data, offs in slices(batch, "__text")]
            every, some = (np.where(there, np.concatenate([np.empty(0, np.int64), *x]), 0) for x in (zip(*parts, strict=True) if parts else ([], [])))
            removed = np.zeros(len(there), np.int64)
            text = plain
            gone_of = batch.column("__gone")
            if gone_of.null_count < len(gone_of):
                texts = plain.to_pylist()
                for i, gone in enumerate(gone_of.to_pylist()):
                    if gone and there[i]:
                        removed[i] = len(gone)
                        gone = set(gone)
                        texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in gone])
                text = pa.array(texts, pa.string())
            left = some - removed
            made = {"__text": text, "n_lines": pa.array(every, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_left": pa.array(left, pa.int64())}
            names = [c for c in batch.schema.names if c not in {"__text", "__gone"}]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made.values()], [*names, *made])

    return run


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated and nearly repeated lines removed from ``text_col``, and n_lines, n_removed, n_left."""
    need(df, id_col, text_col)
    spark = df.sparkSession
    lost = line_groups(texts_of(df, id_col, text_col).withColumn("key", F.xxhash64("text")), Scratch(spark), min_words, similarity)
    counts = ["n_lines", "n_removed", "n_left"]
    names = [c for c in df.columns if c not in counts]
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    bits = filter_of(lost.select("doc_id").distinct())
    id_ = F.col(f"`{id_col}`").cast("long")
    # documents that lose nothing aren't shuffled: a filter of bits lets only some of them pass
    carried = df.select(id_.alias("__id"), F.coalesce(slot_of(id_, 8 * len(bits)), F.lit(0)).alias("__slot"), *others, F.col(f"`{text_col}`").cast("string").alias("__text"))
    shared = spark.sparkContext.broadcast(bits)

    def part(want: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_filter(shared.value, batch.column("__slot").to_numpy())
                yield batch.filter(pa.array(hit == want))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _apply(min_words)(b.append_column("__gone", pa.nulls(b.num_rows, pa.list_(pa.int32()))) for b in run(batches)):
                yield batch.drop_columns(["__id", "__slot"])

        return run if want else counted

    def schema_of(some: DataFrame):
        kept = [f for f in some.schema.fields if f.name not in {"__id", "__key", "__slot", "__text", "__gone"}]
        return type(some.schema)(kept).add("__text", "string").add("n_lines", "long").add("n_removed", "long").add("n_left", "long")

    rest = carried.mapInArrow(lean(part(False)), schema_of(carried))
    lost = lost.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    hit = carried.mapInArrow(lean(part(True)), carried.schema).withColumn("__key", F.xxhash64("__text")).join(lost, ["__id", "__key"], "left")
    hit = hit.drop("__id", "__key", "__slot").mapInArrow(lean(_apply(min_words)), schema_of(carried))
    return rest.unionByName(hit).select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *counts)
