import math
import random
from collections import Counter

import pytest
from public_tokenizers import path

from panelspark.llm.lmscore import MU, START, cross_entropy_difference
from panelspark.llm.wordpieces import word_pieces

TOKENIZER = path("word_bpe_49k.json")


def brute(rows, target):
    tok = word_pieces(TOKENIZER).tokenizer
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    size = tok.get_vocab_size() + 1

    def model(some):
        pairs = Counter(p for x in some for p in zip([START, *x], x, strict=False))
        one, context = Counter(), Counter()
        for (v, w), n in pairs.items():
            one[w] += n
            context[v] += n
        total = sum(one.values())
        return lambda v, w: -math.log((pairs[v, w] + MU * (one[w] + 1) / (total + size)) / (context[v] + MU))

    t, b = model([x for (d, _), x in zip(rows, ids, strict=True) if d in target]), model(ids)
    out = []
    for (d, _), x in zip(rows, ids, strict=True):
        loss = [t(v, w) - b(v, w) for v, w in zip([START, *x], x, strict=False)]
        out.append((d, len(x), sum(loss) / len(x) if x else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("entries", [1 << 20, 60])
def test_equals_brute_force(spark, entries):
    random.seed(1)
    good, bad = [f"{c}at" for c in "bcfhmprs"], [f"{c}og" for c in "bdfhjl"]
    rows = [(0, None), (1, " \n"), (None, "bat hat")]
    for i in range(2, 60):
        rows.append((i, " ".join(random.choices(good if i % 2 else bad, k=random.randint(1, 30)))))
    rows += [rows[5], (7, "another text of seven")]
    target = [i for i in range(3, 60, 4)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    ids = spark.createDataFrame([(i,) for i in [*target, *target]] + [(None,), (999,)], "doc_id long")
    got = sorted((tuple(r) for r in cross_entropy_difference(df, ids, TOKENIZER, entries=entries).collect()), key=str)
    want = brute(rows, set(target))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[2] is None and w[2] is None) or abs(g[2] - w[2]) < 1e-5
    by_id = {g[0]: g[2] for g in got}
    assert max(by_id[i] for i in range(9, 60, 2)) < min(by_id[i] for i in range(8, 60, 2))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy_difference(df.limit(0), none, TOKENIZER).count() == 0
    assert cross_entropy_difference(df, none, TOKENIZER).first().n_tokens == 2
