from panelspark.llm.common import Scratch
from panelspark.llm.pii import replace_pii, surrogates


def test_given_names_do_not_run_out(spark):
    # a given name and a pair of them make 110 Cyrillic surrogates
    entities = [("GIVEN_CYRILLIC_F", f"имя{i}а") for i in range(300)]
    got = surrogates(spark.createDataFrame(entities, "kind string, canon string"), "k", Scratch(spark)).collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(entities)
    assert len({r.surrogate.lower() for r in got}) == len(got)


def test_secrets_without_digits(spark):
    secrets = ["abcdefab" * 4, "AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcXYZ" * 6]
    df = spark.createDataFrame([(i, f"key {x} end") for i, x in enumerate(secrets)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in replace_pii(df, "k", count_col="n").collect()}
    assert all(got[i][1] == 1 and x not in got[i][0] for i, x in enumerate(secrets))
