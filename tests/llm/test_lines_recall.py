import random

import corpus_pipeline
from panelspark.llm.queries import op6_fuzzy_lines
from tests.llm.test_lines import brute


def changed(seed, n):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzéд", k=random.randint(2, 9))) for _ in range(400)]
    base = [random.choices(vocabulary, k=k) for k in (5, 6, 8, 10, 10, 15, 20, 20, 30, 50)]
    rows = []
    for i in range(n):
        some = []
        for w in random.sample(base, 3):
            w = list(w)
            for _ in range(max(1, len(w) // 15)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            some.append(" ".join(w))
        rows.append((i, "\n".join(some)))
    return rows


def save(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def check(rows, texts):
    """Candidates are found by chance: nothing else goes, and nearly all that should go does."""
    got = {(i, x) for i, t in texts for x in t.split("\n")}
    every = {(i, x) for i, t in rows for x in t.split("\n")}
    want = {(i, x) for i, _, _, t in brute(rows) for x in t.split("\n") if x}
    assert got >= want
    assert len(every - got) >= 0.95 * len(every - want) > 0.5 * len(every)


def test_query_finds_lines_with_changed_words(spark, tmp_path):
    rows = changed(4, 60)
    check(rows, [(r.doc_id, r.text) for r in op6_fuzzy_lines(spark, save(spark, rows, tmp_path)).collect()])


def test_pipeline_finds_lines_with_changed_words(spark, tmp_path):
    rows = changed(5, 40)
    docs = spark.read.parquet(save(spark, rows, tmp_path) + "/documents.parquet")
    check(rows, [(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()])
