import random
import re

import pytest

from panelspark.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    def fold(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    sets = []
    for doc, text in rows:
        w = WORD.findall(fold(text))
        sets.append((doc, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(x), find(d), find(d) == d) for d, x in sets)


def corpus(seed, n):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "É"), (8, "é")]
    base = [random.choices(vocabulary, k=80) for _ in range(6)]
    for i in range(9, n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 3, 4, 5, 6, 8, 20])):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (5, 2)])
def test_components_equal_brute_force(spark, size, seed):
    rows = corpus(seed, 260)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, rep string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, size=size).collect())
    assert got == brute(rows, size, 80)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, other), (7, text), (9, other)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("7", 5, False), ("9", 5, False), ("None", None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_document_with_two_texts_joins_their_classes(spark):
    random.seed(8)
    a, b = ([f"{k}{random.randrange(900)}" for _ in range(80)] for k in "ab")
    near_a, near_b = [*a[:-1], "x"], [*b[:-1], "y"]
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (4, random.choices(a, k=60))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_a_large_group_of_copies_equals_brute_force(spark):
    """Copies of one text, many of them too far from it: only some of these are near to one another."""
    random.seed(11)
    base = [f"w{random.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(220):
        w = list(rows[random.randrange(i)][1].split(" ")) if i and random.random() < 0.3 else list(base)
        for _ in range(random.choice([1, 2, 4, 6, 7, 8])):
            k = random.randrange(len(w))
            w[k : k + random.randint(0, 1)] = [f"w{random.randrange(300)}"] * random.randint(0, 2)
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect())
    want = brute(rows, 2, 80)
    assert got == want and 10 < sum(kept for *_, kept in want) < 200
