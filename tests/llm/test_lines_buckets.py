import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from panelspark.llm import lines as module


def test_packed_buckets_are_those_of_all_keys():
    random.seed(5)
    keys = [random.getrandbits(64) for _ in range(400)]
    rows = [(random.randrange(-60, 60), sorted(random.sample(keys, 9))) for _ in range(90)]
    bands = pa.array([np.array(b, np.uint64).tobytes() for _, b in rows], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([line for line, _ in rows]), bands], ["line", "bands"])
    got = {}
    for turn in range(module.PASSES):
        # in two tasks; a task that reads them gets the blocks in the order of their parts
        dealt = [row for half in (batch.slice(0, 40), batch.slice(40)) for b in module._deal(turn)(iter([half])) for row in b.to_pylist()]
        dealt.sort(key=lambda row: row["part"])
        blocks = pa.RecordBatch.from_pylist(dealt, pa.schema([("part", pa.int32()), ("block", pa.binary())]))
        for b in module._meet(iter([blocks.slice(0, 33), blocks.slice(33)])):
            for row in b.to_pylist():
                got[row["first"], row["rep"]] = max(row["n"], got.get((row["first"], row["rep"]), 0))
    buckets = defaultdict(list)
    for line, some in rows:
        for key in some:
            buckets[key].append(line)
    want = {}
    for members in buckets.values():
        if min(members) < max(members):
            for line in members:
                want[min(members), line] = max(len(members), want.get((min(members), line), 0))
    assert got == want and len(want) > 100


def test_lines_side_by_side_are_compared_like_one_by_one():
    random.seed(6)
    pairs = []
    for _ in range(600):
        a = [random.choice(["ab", "é", "zu", "中文", "lang", "wort", "0"]) for _ in range(random.randrange(1, 60))]
        b = [w if random.random() > random.choice([0.1, 0.3, 0.5]) else random.choice(["xy", "ü", "neu"]) for w in a]
        pairs.append((" ".join(a), " ".join(b)))
    pairs += [("a", "b"), ("ab", "a"), ("x" * 5000, "x" * 4500 + "y" * 500)]
    want = [module.near(a, b, 0.8) for a, b in pairs]
    assert module.near_all(pairs, 0.8) == want and 50 < sum(want) < 550
    assert module.near_all([], 0.8) == []


def test_counts_without_lower_case():
    texts = ["", "\n", "one", "one\n", "\n two \n\n-- !\nİ K ſ\n", "a-b\nc", "\tx\r\n\x0b", "é\n\n", None, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.nulls(len(texts), pa.list_(pa.int32()))], ["__text", "__gone"])
    for least in (1, 2):
        (got,) = module._apply(least)(iter([batch]))
        words = [[len("".join(c if c.isalnum() or ord(c) > 127 else " " for c in line).split(" ")) - "".join(c if c.isalnum() or ord(c) > 127 else " " for c in line).split(" ").count("") for line in (t or "").split("\n")] for t in texts]
        assert got.column("n_lines").to_pylist() == [len(w) if t is not None else 0 for t, w in zip(texts, words, strict=True)]
        assert got.column("n_left").to_pylist() == [sum(n >= least for n in w) if t is not None else 0 for t, w in zip(texts, words, strict=True)]
        assert got.column("__text").to_pylist() == texts
