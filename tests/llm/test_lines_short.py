import corpus_pipeline
from panelspark.llm.queries import op6_fuzzy_lines

ROWS = [
    (1, "All rights reserved.\none\n\nこれは本文です。"),
    (2, "all rights reserved\ntwo\n\nOK"),
    (3, "これは本文です。\nALL RIGHTS RESERVED!\nthree\nok"),
    (4, "--\n\n--"),
]
KEPT = {1: ROWS[0][1], 2: "two\n\nOK", 3: "three", 4: ROWS[3][1]}


def test_short_lines_and_lines_without_spaces_are_deduplicated(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_left) for r in op6_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (KEPT[1], 4, 0, 3), 2: (KEPT[2], 4, 1, 2), 3: (KEPT[3], 4, 3, 1), 4: (KEPT[4], 3, 0, 0)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == KEPT
