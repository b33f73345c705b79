import corpus_pipeline

REPEATED = "permission is granted to copy this text for any use"


def test_short_unique_lines_keep_their_document(spark):
    rows = [
        (1, f"first heading\n{REPEATED}"),
        (2, f"{REPEATED}\nroses are red\nviolets blue"),
        (3, f"{REPEATED}\n\n--- * ---\n"),
        (4, REPEATED),
        (5, "only short lines\nno more"),
    ]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    kept = {1: rows[0][1], 2: "roses are red\nviolets blue", 5: rows[4][1]}
    assert got == {i: (t, len(t)) for i, t in kept.items()}
