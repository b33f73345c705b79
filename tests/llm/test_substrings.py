import random
import re

import pytest

from panelspark.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, n, window):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(50)] + ["Ä", "ä", "𝄞"]
    passages = [random.choices(vocabulary, k=random.choice([window - 1, window, window + 1, 3 * window])) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \n ")]
    for i in range(3, n):
        w = random.choices(vocabulary, k=random.randint(0, 2 * window))
        for _ in range(random.choice([0, 1, 2])):
            p = random.choice(passages)
            at = random.randint(0, len(w))
            w = w[:at] + p + w[at:]
        rows.append((random.randint(3, n), random.choice([" ", "\n", " \t"]).join(w)))
    rows += [(900, "a " * 3 * window), (901, "a " * 2 * window), (902, rows[10][1]), (4, rows[11][1]), (902, rows[10][1]), (None, rows[11][1])]
    return rows


@pytest.mark.parametrize(("window", "entries"), [(10, 1 << 20), (7, 100), (2, 1 << 20)])
def test_equals_brute_force(spark, window, entries):
    rows = corpus(window, 150, window)
    df = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id long, text string, kept string, key int")
    got = sorted((tuple(r) for r in remove_repeats(df, window, entries=entries).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=1)
