import random
import re

from panelspark.llm import lines as module
from panelspark.llm.lines import dedup_lines


def normal(line):
    return " ".join(re.sub(r"[0-9]", "0", re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", line.lower())).split(" ")).split()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_words=1, similarity=0.8):
    """Groups by edit similarity alone."""
    places = {}
    for d, t in sorted({(d, t) for d, t in rows if t is not None and d is not None}):
        for k, line in enumerate(t.split("\n")):
            w = tuple(normal(line))
            if len(w) >= min_words:
                places.setdefault(w, []).append((d, k))
    keys = list(places)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = " ".join(a), " ".join(b)
            longer = max(len(x), len(y))
            if abs(len(x) - len(y)) <= (1 - similarity) * longer + 1e-9 and 1 - edit(x, y) / longer >= similarity - 1e-12:
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(places[k])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        split = t.split("\n")
        kept = [x for k, x in enumerate(split) if (d, k) not in gone]
        out.append((d, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, n):
    random.seed(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "ÉL") for b in ("n", "rt", "st", "la")]
    base = [random.choices(vocabulary, k=random.choice([3, 5, 40, 90])) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c d e\na b c d e\n\nA, b: c d E"), (4, "page 3 of 10 in all"), (5, "Page 7 of 99 in all\n")]
    for i in range(6, n):
        some = []
        for _ in range(random.randint(1, 5)):
            w = list(random.choice(base))
            if random.random() < 0.5:
                w[random.randrange(len(w))] += random.choice(["x", "", "!", "7"])
            some.append(" ".join(w))
        rows.append((i, "\n".join(some)))
    return rows


def test_edit_distance():
    random.seed(9)
    for _ in range(3000):
        a, b = ("".join(random.choices("abé", k=random.randint(0, 9))) for _ in range(2))
        assert module.edit_distance(a, b) == edit(a, b)


def test_near_is_the_edit_similarity():
    random.seed(10)
    for _ in range(1500):
        x = random.choices(["ab", "c", "def", "abab", "é"], k=random.randint(1, 12))
        y = list(x)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(y) + 1)
            y[k : k + random.randint(0, 1)] = random.choices(["ab", "c", "xyz"], k=random.randint(0, 2))
        a, b = " ".join(x), " ".join(y)
        assert module.near(a, b, 0.8) == (edit(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9))


def test_equals_brute_force(spark):
    rows = corpus(1, 90)
    rows += [rows[7], rows[8]]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, line string")
    got = dedup_lines(df, min_words=3)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_removed", "n_left"]
    want = brute(rows, 3)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == want
    fuzzy = sum(x[2] for x in want) - sum(x[2] for x in brute(rows, 3, 1.0))
    assert fuzzy > 0


def test_missing_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e\nshort")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text, r.n_left) for r in dedup_lines(df).collect()), key=str) == [(1, "a b c d e", 1), (2, "short", 1), (None, "a b c d e", 1)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_lines(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(150_000)]
    long = " ".join(words)
    other = " ".join(words[:70_000] + ["more", "words"] + words[70_003:])
    unspaced, unspaced_too = "語" * 3000 + "文字" * 2000, "語" * 3000 + "文字" * 2000 + "終"
    df = spark.createDataFrame([(1, long), (2, "first\n" + other), (3, unspaced), (4, unspaced_too + "\nlast")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {1: long, 2: "first", 3: unspaced, 4: "last"}


def test_a_passage_that_many_lines_hold_makes_no_pairs(spark):
    """Lines that share a third of their words stay, and near copies among them go all the same."""
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 8))) for _ in range(3000)]
    passage = random.choices(vocabulary, k=30)
    rows = []
    for i in range(150):
        own = random.choices(vocabulary, k=60)
        rows.append((2 * i, " ".join(own[:30] + passage + own[30:])))
        if i % 3 == 0:
            own[random.randrange(60)] = "changed"
            rows.append((2 * i + 1, " ".join(own[:30] + passage + own[30:])))
    got = {r.doc_id for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text}
    assert got == {i for i, _ in rows if i % 2 == 0}
