"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

Everything is a DataFrame expression; no Python runs on the executors.

1. One pattern finds e-mail addresses, secrets, IP addresses, phone, identity, account and card numbers, and names of
   people (after a form of address, or a known given name before another name).
2. Each distinct entity of the corpus, in a canonical form without the format of the place (numbers without separators,
   addresses in lower case, each part of a name by itself), gets a surrogate derived from the key.  Country codes,
   top-level domains, private networks, card brands, checksums that hold, lengths, letter case and separators stay.
3. Collision check: two entities of a type must not share a surrogate, and no surrogate may be an entity that
   occurs.  Of those that collide all but one are derived anew, and no others, until none is left.  So equal entities keep equal
   surrogates (coreference) and different ones stay different.
4. Surrogates are put back in the format of each place.

Only documents with entities are joined, by a digest of the text; a text that occurs many times is looked up once.
Null and empty texts and texts without entities come back as they are, as do all other columns.  Repeated rows are
changed alike.  Names starting with ``__pii_`` are reserved.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need

#: Forms of address by gender, given names by gender, and parts of the names that stand in.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
OTHER_TITLES = ["Dr", "Prof"]
FEMALE_LATIN = ["Alice", "Anna", "Barbara", "Camille", "Carmen", "Clara", "Elena", "Emily", "Emma", "Hannah", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucia", "Maria", "Mary", "Olivia", "Patricia", "Sarah", "Sofia", "Susan", "Teresa"]
MALE_LATIN = ["Andrew", "Antonio", "Carlos", "Daniel", "David", "Diego", "Felix", "François", "George", "Hans", "Henry", "James", "Jean", "John", "José", "Juan", "Lukas", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Елена", "Ирина", "Мария", "Надежда", "Наталья", "Ольга", "Светлана", "Татьяна"]
MALE_CYRILLIC = ["Алексей", "Андрей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей"]
STEMS_LATIN = ["Ash", "Berg", "Birk", "Brad", "Cald", "Dun", "Elm", "Fair", "Glen", "Hart", "Holm", "Kirk", "Lang", "Marl", "Nor", "Oak", "Pem", "Rams", "Stan", "Thorn", "Wal", "West", "Whit", "Yar"]
ENDS_LATIN = ["bury", "by", "den", "field", "ford", "gate", "ham", "hurst", "ley", "low", "man", "mere", "mont", "ridge", "son", "stead", "stone", "ton", "well", "wick", "wood", "worth"]
STEMS_CYRILLIC = ["Бел", "Волк", "Горд", "Дуб", "Жар", "Зим", "Кам", "Лес", "Мор", "Нов", "Озер", "Пол", "Рыж", "Сад", "Тих", "Холм"]
ENDS_CYRILLIC = ["ин", "ов", "енков", "янов", "анов", "еев"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CYR_UPPER, _CYR_LOWER = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}\p{Ll}+"
_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_GIVEN = "|".join(FEMALE_LATIN + MALE_LATIN + FEMALE_CYRILLIC + MALE_CYRILLIC)
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,128}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){1,8}"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![\p{L}\p{N}])"
IP = rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\p{{N}}|\.\p{{N}})"
PHONE = r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\p{L}\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![.\-]?\d))"
SSN = r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\-]?\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|3\d{3}[ \-]\d{6}[ \-]\d{5})(?!\d)"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_GIVEN}) {_NAME}(?: {_NAME})?)(?![\p{{L}}\p{{N}}])"
PATTERN = "|".join([EMAIL, SECRET, IP, PHONE, SSN, IBAN, CARD, PERSON])

#: Rounds after which a type's space of surrogates counts as exhausted.
ROUNDS = 64


def _type(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "EMAIL")
        .when(m.rlike(rf"^(?:{SECRET})$"), "SECRET")
        .when(m.rlike(r"^\d+(?:\.\d+){3}$"), "IP")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(m.rlike(r"^(?:\+|\(|\d{3}[.\-]\d{3}[.\-]\d{4}$)"), "PHONE")
        .when(m.rlike(r"^\d"), "CARD")
        .when(m.rlike(r"^[A-Z]{2}\d"), "IBAN")
        .otherwise("PERSON")
    )


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, r"[^\p{L}\p{N}]", "")


def _canon(kind: Column, m: Column) -> Column:
    return F.when(kind.isin("PHONE", "SSN", "CARD", "IBAN"), F.upper(_bare(m))).otherwise(F.lower(m))


def _pieces(m: Column) -> Column:
    """The parts of a match as (kind, canon, raw): one, or each word of a name; a form of address has no kind."""
    title = F.regexp_extract(m, rf"^({_TITLES})\.? ", 1)
    words = F.split(m, " ")
    names = F.size(words) - F.when(title != "", 1).otherwise(0)

    def named(w: Column, i: Column) -> Column:
        place = i - F.when(title != "", 1).otherwise(0)
        script = F.when(w.rlike(r"^\p{IsCyrillic}"), "CYRILLIC").otherwise("LATIN")
        gender = (
            F.when(w.isin(FEMALE_LATIN + FEMALE_CYRILLIC), "F")
            .when(w.isin(MALE_LATIN + MALE_CYRILLIC), "M")
            .when(title.isin(FEMALE_TITLES), "F")
            .when(title.isin(MALE_TITLES), "M")
            .otherwise(F.when(w.rlike(r"[аяa]$"), "F").otherwise("M"))
        )
        known = w.isin(FEMALE_LATIN + MALE_LATIN + FEMALE_CYRILLIC + MALE_CYRILLIC)
        given = known | ((place < names - 1) & (names > 1))
        # in Cyrillic the family name shows the gender too
        family = F.concat(F.lit("FAMILY_"), script, F.when(script == "CYRILLIC", F.when(w.rlike("а$"), "_F").otherwise("_M")).otherwise(""))
        kind = F.when(place < 0, F.lit(None).cast("string")).when(given, F.concat(F.lit("GIVEN_"), script, F.lit("_"), gender)).otherwise(family)
        return F.struct(kind.alias("kind"), F.lower(w).alias("canon"), w.alias("raw"))

    kind = _type(m)
    alone = F.array(F.struct(kind.alias("kind"), _canon(kind, m).alias("canon"), m.alias("raw")))
    return F.when(kind == "PERSON", F.transform(words, named)).otherwise(alone)


def _pick(choices: str | list[str], v: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), v % len(choices) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), v % len(choices) + 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Sum of the check rule over a string of digits, the last one not doubled."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) >= 53, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


class _Maker:
    """Surrogates of (kind, canon, attempt), as expressions."""

    def __init__(self, secret: str):
        self.outer, self.inner = (sha256(f"{part}:{secret}".encode()).hexdigest() for part in ("outer", "inner"))

    def digest(self, x: Column) -> Column:
        within = F.sha2(F.concat(F.lit(self.inner), x).cast("binary"), 256)
        return F.sha2(F.concat(F.lit(self.outer), within).cast("binary"), 256)

    def stream(self, kind: Column, canon: Column, attempt: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.char_length(canon) / 16).cast("int") + 1)
        return F.array_join(F.transform(blocks, lambda b: self.digest(F.concat_ws("|", kind, attempt.cast("string"), b.cast("string"), canon))), "")

    def make(self) -> Column:
        """From the columns kind, canon, attempt and stream."""
        kind, canon, attempt, stream = (F.col(c) for c in ("kind", "canon", "attempt", "stream"))

        def value(i: Column | int) -> Column:
            i = F.lit(i) if isinstance(i, int) else i
            return F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")

        def swap(c: Column, i: Column) -> Column:
            v = value(i)
            return (
                F.when(c.rlike("[0-9]"), _pick("0123456789", v))
                .when(c.rlike("[A-Z]"), _pick(_UPPER, v))
                .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick(_CYR_UPPER, v)).otherwise(_pick(_CYR_LOWER, v)))
                .when(c.rlike(r"\p{Lu}"), _pick(_UPPER, v))
                .when(c.rlike(r"\p{L}"), _pick(_LOWER, v))
                .otherwise(c)
            )

        chars = _chars(canon)
        swapped = F.array_join(F.transform(chars, swap), "")
        n = F.char_length(canon)

        def keep(front: Column) -> Column:
            return F.concat(F.substr(canon, F.lit(1), front), F.substr(swapped, front + 1, n))

        tld = F.char_length(F.regexp_extract(canon, r"\.[^.@]*$", 0))
        email = F.concat(F.substr(swapped, F.lit(1), n - tld), F.substr(canon, n - tld + 1, tld))
        hexes = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", value(i))).otherwise(c)), "")
        secret = F.when(canon.rlike("^[0-9a-f]+$"), hexes).when(canon.rlike("^gh[a-z]_"), keep(F.lit(4))).otherwise(keep(F.lit(4)))
        octets = F.split(canon, r"\.")
        private = canon.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\.")
        ip = F.concat_ws(".", *[F.when(private & F.lit(i < 2), octets[i]).otherwise((value(i) % 254 + 1).cast("string")) for i in range(4)])
        front = F.greatest(n - 10, F.lit(0))
        phone = F.concat(F.substr(canon, F.lit(1), front), _pick("23456789", value(0)), F.substr(swapped, front + 2, n))
        ssn = F.concat(_pick("12345", value(0)), F.array_join(F.transform(F.slice(chars, 2, 8), lambda c, i: _pick("123456789", value(i + 1))), ""))
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(swapped, F.lit(2), n - 2))
        check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        valid = _luhn(canon) % 10 == 0
        card = F.concat(body, F.when(valid, check).otherwise((check + 1 + value(n) % 9) % 10).cast("string"))
        country, bban = F.substr(canon, F.lit(1), F.lit(2)), F.substr(swapped, F.lit(5), n)
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)

        def more(parts: list[str]) -> Column:
            """One part more every four attempts, so that names never run out."""
            return F.when(attempt >= 4, F.transform(F.sequence(F.lit(2), F.floor(attempt / 4).cast("int") + 1), lambda i: _pick(parts, value(i)))).otherwise(F.array().cast("array<string>"))

        def person(parts: list[str], sep: str) -> Column:
            return F.concat_ws(sep, _pick(parts, value(0)), more(parts))

        def family(stems: list[str], ends: list[str], tail: str) -> Column:
            return F.concat(_pick(stems, value(0)), F.lower(F.array_join(more(stems), "")), _pick(ends, value(1)), F.lit(tail))

        given = {
            "GIVEN_LATIN_F": person(FEMALE_LATIN, "-"),
            "GIVEN_LATIN_M": person(MALE_LATIN, "-"),
            "GIVEN_CYRILLIC_F": person(FEMALE_CYRILLIC, "-"),
            "GIVEN_CYRILLIC_M": person(MALE_CYRILLIC, "-"),
            "FAMILY_LATIN": family(STEMS_LATIN, ENDS_LATIN, ""),
            "FAMILY_CYRILLIC_F": family(STEMS_CYRILLIC, ENDS_CYRILLIC, "а"),
            "FAMILY_CYRILLIC_M": family(STEMS_CYRILLIC, ENDS_CYRILLIC, ""),
        }
        made = F.when(kind == "EMAIL", email).when(kind == "SECRET", secret).when(kind == "IP", ip).when(kind == "PHONE", phone).when(kind == "SSN", ssn).when(kind == "CARD", card).when(kind == "IBAN", iban)
        for name, expression in given.items():
            made = made.when(kind == name, expression)
        return made


def _render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one place: its separators and letter case."""

    def place(c: Column, i: Column) -> Column:
        same = kind.isin("EMAIL", "IP", "SECRET")
        at = F.when(same, i + 1).otherwise(F.char_length(_bare(F.substr(raw, F.lit(1), i + 1))))
        new = F.substr(surrogate, at, F.lit(1))
        return F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{Lu}"), F.upper(new)).when(c.rlike(r"\p{Ll}"), F.lower(new)).otherwise(new)

    # octets change their length, and names are spelt out
    whole = (kind == "IP") | kind.startswith("GIVEN") | kind.startswith("FAMILY")
    return F.when(whole, surrogate).otherwise(F.array_join(F.transform(_chars(raw), place), ""))


def surrogates(entities: DataFrame, secret: str, scratch: Scratch) -> DataFrame:
    """kind, canon, surrogate of every distinct (kind, canon): surrogates of a kind are distinct and aren't entities."""
    maker = _Maker(secret)
    every = scratch.save(entities.select("kind", "canon").where("kind is not null").distinct(), "all")
    taken = every.select("kind", F.lower("canon").alias("low"))
    pending, settled = every, None
    for i in range(ROUNDS):
        made = pending.withColumn("attempt", F.lit(i)).withColumn("stream", maker.stream(F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("surrogate", maker.make())
        made = scratch.save(made.select("kind", "canon", "surrogate", F.lower("surrogate").alias("low")), f"made{i}")
        free = made.groupBy("kind", "low").agg(F.min("canon").alias("canon"))
        free = free.join(taken, ["kind", "low"], "left_anti") if settled is None else free.join(taken, ["kind", "low"], "left_anti").join(settled, ["kind", "low"], "left_anti")
        # only those that lost are derived anew
        won = scratch.save(made.join(free, ["kind", "low", "canon"], "left_semi"), f"won{i}")
        settled = won if settled is None else settled.unionByName(won)
        pending = scratch.save(made.join(won, ["kind", "canon"], "left_anti").select("kind", "canon"), f"pending{i}")
        if pending.isEmpty():
            return settled.select("kind", "canon", "surrogate")
    raise ValueError("more entities of a kind than surrogates")


def replace_pii(df: DataFrame, secret: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with the entities of ``text_col`` replaced; ``count_col`` names an added column with their number."""
    need(df, text_col)
    scratch = Scratch(df.sparkSession)
    text, matches = F.col(f"`{text_col}`"), F.col("__pii_matches")
    columns = [F.col(f"`{c}`") for c in df.columns if c != count_col]
    number = [F.size(matches).alias(count_col)] if count_col else []
    found = F.when(text.rlike(r"[0-9@]|\p{Lu}\p{Ll}++\.? \p{Lu}\p{Ll}|[A-Fa-f]{32}|AKIA[A-Z]{16}|gh[pousr]_[A-Za-z]{36}"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    marked = df.withColumn("__pii_matches", F.coalesce(found, F.array().cast("array<string>")))
    as_is = marked.where(F.size(matches) == 0).select(*columns, *number)
    hit = marked.where(F.size(matches) > 0).withColumn("__pii_key", F.sha2(text.cast("binary"), 256))
    hit = scratch.save(hit, "hits")
    pieces = F.transform(matches, _pieces)
    once = hit.select("__pii_key", "__pii_matches").dropDuplicates(["__pii_key"])
    each = once.select("__pii_key", F.explode(F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.transform(p, lambda x: F.struct(x["kind"].alias("kind"), x["canon"].alias("canon"))))))).alias("e"))
    each = scratch.save(each.select("__pii_key", "e.kind", "e.canon").where("kind is not null"), "entities")
    known = surrogates(each, secret, scratch)
    entry = F.struct(F.concat_ws(":", "kind", "canon"), "surrogate")
    maps = each.join(known, ["kind", "canon"]).groupBy("__pii_key").agg(F.map_from_entries(F.collect_list(entry)).alias("__pii_map"))
    maps = scratch.save(maps, "maps")

    def replaced(m: Column) -> Column:
        def one(p: Column) -> Column:
            new = F.element_at(F.col("__pii_map"), F.concat_ws(":", p["kind"], p["canon"]))
            return F.when(new.isNotNull(), _render(p["kind"], p["raw"], new)).otherwise(p["raw"])

        return F.array_join(F.transform(_pieces(m), one), " ")

    gaps = F.split(text, PATTERN, -1)
    woven = F.transform(F.arrays_zip(gaps.alias("gap"), F.transform(matches, replaced).alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit(""))))
    changed = hit.join(maps, "__pii_key").withColumn(text_col, F.array_join(woven, ""))
    return as_is.unionByName(changed.select(*columns, *number))
