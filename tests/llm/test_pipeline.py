import random

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_packing import check_packing


def test_every_stage_against_brute_force(spark, tmp_path):
    random.seed(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "st")]
    rows = []
    for i in range(160):
        if i % 5 == 0:
            text = " ".join(x.upper() + "!!" for x in random.choices(vocabulary, k=40))
        elif i % 16 == 3:
            text = rows[random.randrange(1, i)][1]
        elif i % 16 == 7:
            w = rows[1][1].split("\n")
            text = "\n".join([*w[:3], " ".join(random.choices(vocabulary, k=9))])
        else:
            text = "\n".join(" ".join(random.choices(vocabulary, k=random.randint(6, 30))) for _ in range(4))
            if i % 7 == 0:
                text += f"\nwrite to user{i}@mail.example.com or call +1 (168) 555-{1000 + i}"
        rows.append((i, text, "en", "s", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 5 != 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
    first = {r.doc_id: r for r in out["quality classifier"]}
    assert set(first) == {i for i in range(160) if i % 5}
    lines = {d: (n, gone, t) for d, n, gone, t in brute_lines([(i, r.text) for i, r in first.items()])}
    second = {r.doc_id: r for r in out["line dedup"]}
    assert {i: r.text for i, r in second.items()} == {i: t for i, (n, gone, t) in lines.items() if not gone or t}
    assert len(second) < len(first) and all(r.n_chars == len(r.text) for r in second.values())
    third = {r.doc_id: r for r in out["MinHash near-dedup"]}
    assert set(third) == {d for d, _, _, kept in brute_groups([(i, r.text) for i, r in second.items()], 5, 80) if kept}
    assert all(third[i] == second[i] for i in third)
    fourth = {r.doc_id: r for r in out["PII"]}
    assert set(fourth) == set(third)
    for i, r in fourth.items():
        mailed = "@mail.example" in third[i].text
        assert (r.text == third[i].text) is not mailed and f"user{i}@" not in r.text and len(r.text) == r.n_chars
    packed = out["best-fit packing"]
    assert {r.doc_id for r in packed} == set(fourth)
    check_packing(packed, 4096)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
