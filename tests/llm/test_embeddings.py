import numpy as np

from panelspark.llm.embeddings import near_vectors, recall


def brute(rows, threshold):
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[q] = p
    return sorted((rows[i][0], links[i], rows[find(i)][0], rows[i][0] == rows[find(i)][0]) for i in range(n))


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    out = []
    for i in range(420):
        v = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])
        out.append([float(x) for x in v])
    out += [[float(x) for x in base[0] + rng.normal(size=16) * 0.02] for _ in range(120)]
    return out


def test_links_and_components_equal_brute_force(spark):
    rows = [*enumerate(vectors(1))]
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e200] * 16, [1e-200] * 16]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = near_vectors(df, 0.9, probes=20, per_cell=30, block=40, sample=200)
    rows[-2:] = [(1008, [1.0] * 16), (1009, [1.0] * 16)]
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.9)


def test_recall_with_few_probes(spark):
    rows = [*enumerate(vectors(2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_vectors(df, 0.9, per_cell=30)
    assert recall(got, df, 0.9, every=1) >= 0.9
    want = {r[0]: r[1] for r in brute(rows, 0.9)}
    assert all(r.n_links <= want[r.vec_id] for r in got.collect())


def test_empty_table_and_only_unusable(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert near_vectors(df.limit(0)).count() == 0
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
