import re

from pyspark.sql import functions as F

from panelspark.llm.common import Scratch
from panelspark.llm.pii import FEMALE_CYRILLIC, FEMALE_LATIN, MALE_LATIN, replace_pii, surrogates

TEXTS = [
    "Mail a.B@x1.co.uk and A.b@x1.co.uk, call +1 (168) 555-5254 or +1-168-555-5254.",
    "Card 4111111111111111, 4111-1111-1111-1111, 4111111111111112; ip 10.1.2.3, 97.51.17.173.",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"; ssn 123-45-6789; GB82 WEST 1234 5698 7654 32',
    "Mr. John Smith met Mrs. Anna Smith. John Smith said: Госпожа Ольга Иванова. Dr. Weiß agrees.",
    "pfü.34@mail7.example.com!! 97.51.17.173*** 4111111111111111###",
    None,
    "",
    "Nothing here. The The 12, CC BY-NC 4.0, 1.2.3, 555-1234, 2024-01-02, Of Of, $5.00 " + "x" * 500,
]


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    return {r.doc_id: r for r in replace_pii(df, key, count_col="n_replaced").collect()}


def luhn(s):
    d = [int(x) for x in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_surrogates_keep_type_format_gender_and_script(spark):
    got = run(spark, TEXTS)
    mail = re.fullmatch(r"Mail (\w\.\w@\w\d\.\w\w\.uk) and (\w\.\w@\w\d\.\w\w\.uk), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4})\.", got[0].text)
    assert mail and mail[1].lower() == mail[2].lower() and mail[1] != mail[2] and "x1.co" not in got[0].text.lower()
    assert re.sub(r"\D", "", mail[3]) == re.sub(r"\D", "", mail[4]) != "11685555254"
    card = re.fullmatch(r"Card (4\d{15}), (4\d{3}-\d{4}-\d{4}-\d{4}), (4\d{15}); ip (10\.1\.\d+\.\d+), (\d+\.\d+\.\d+\.\d+)\.", got[1].text)
    assert card and card[1] == card[2].replace("-", "") != card[3]
    assert luhn(card[1]) and not luhn(card[3]) and "4111111111111111" not in got[1].text
    assert all(0 < int(x) < 255 for x in card[5].split("."))
    secret = re.fullmatch(r'token = "([0-9a-f]{40})"; ssn ([1-5]\d\d-\d\d-\d{4}); (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d)', got[2].text)
    assert secret and not secret[1].startswith("04db")
    iban = secret[3].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. (\w+) (\w+) said: Госпожа (\w+) (\w+а)\. Dr\. (\w+) agrees\.", got[3].text)
    assert names and names[1] in MALE_LATIN and names[3] in FEMALE_LATIN and names[7] in FEMALE_CYRILLIC
    assert names[2] == names[4] == names[6] and names[1] == names[5] and names[9] != names[2] and names[2] != "Smith"
    assert got[4].text.split("!! ")[1] == f"{card[5]}*** {card[1]}###"
    assert [got[i].n_replaced for i in range(8)] == [4, 5, 3, 5, 3, 0, 0, 0]
    assert [got[i].text for i in (5, 6, 7)] == TEXTS[5:] and all(r.n == "kept" for r in got.values())


def test_key_decides_and_copies_agree(spark):
    texts = [TEXTS[0], TEXTS[0], TEXTS[0] + " " + TEXTS[1]]
    one, two = run(spark, texts), run(spark, texts, "other")
    assert one[0].text == one[1].text and one[2].text.startswith(one[0].text)
    assert one[0].text != two[0].text
    assert run(spark, texts)[2].text == one[2].text


def test_collisions_are_resolved(spark):
    # many more names than pairs of parts, and addresses of two characters that often meet
    entities = [("FAMILY_LATIN", f"name{i}") for i in range(900)] + [("EMAIL", f"{a}{b}@c.de") for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([*entities, *entities, (None, "x")], "kind string, canon string")
    got = surrogates(df, "k", Scratch(spark)).collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(entities)
    assert len({(r.kind, r.surrogate.lower()) for r in got}) == len(got)
    assert not {(r.kind, r.surrogate.lower()) for r in got} & set(entities)


def test_empty_table_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.de")], "doc_id long, text string")
    assert replace_pii(df.limit(0), "k").count() == 0
    out = replace_pii(df.withColumn("x", F.lit(1)), "k")
    assert out.columns == ["doc_id", "text", "x"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
