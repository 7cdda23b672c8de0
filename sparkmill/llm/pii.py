"""Personal data and secrets become surrogates, with DataFrame operations only.

One pattern finds all kinds of entities; a text is split at them, and each is replaced by a
surrogate of its kind: digits by digits, letters by letters of their script and case, hexadecimal by
hexadecimal; cards with a valid check digit get a valid one, and IBANs valid check digits; addresses keep their shape, telephone numbers their
country code, e-mail addresses their top-level domain; first names after a title become names of that
title's gender. What replaces what is drawn from SHA-2 over a key, the kind, and the entity without its punctuation
and case, so an entity has one surrogate wherever and however it is written.

Two different entities of a kind must not share a surrogate, nor may a surrogate be an entity that
the corpus holds: the distinct entities are drawn again, with another number, until that holds, the
smallest of those that clash keeping its draw. A name drawn again is composed of one listed name more,
so that names don't run out; those of both genders are told apart from all names of the corpus. E-mail
addresses and secrets may be short: from MOST_ROUNDS draws on they get a letter more with each. If
entities still clash after LAST_ROUND draws, as too few of their shape are free, that is an error.

Defined results: a null text stays null with no entities; extra columns pass through, but for those
named n_entities and kinds, which are replaced. Repeated rows each get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import written

# The kinds of entity, most specific first, as Java patterns.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-﷐])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ipv4": r"(?<![\w.﷐])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w﷑]|\.\d)",
    "access_key": r"(?<![\w﷐])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w﷑])",
    "iban": r"(?<![\w﷐])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w﷑])",
    "card": r"(?<![\w﷐])[3-6]\d{3}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{3,4}(?![\w﷑])",
    "ssn": r"(?<![\w\-﷐])\d{3}-\d{2}-\d{4}(?![\w\-﷑])",
    "phone": r"(?<![\w﷐])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d|﷑)",
}
# What stands before a secret, and before a name by gender.
SECRET_AFTER = r"(?:password|passwd|pwd|secret|token|api_key|apikey) {0,3}[=:] {0,3}[\"']?"
TITLES = {"name_f": "Mrs|Ms|Miss|Frau|Mme|Mlle|Señora", "name_m": "Mr|Herr|Señor"}
# A text without any of this has no entity.
SIGNS = r"[0-9@=:]|\b(?:" + "|".join(TITLES.values()) + r")\.? \p{Lu}"
# Surrogate names by gender.
NAMES = {
    "name_f": ["Anna", "Beatriz", "Carla", "Diana", "Elena", "Flora", "Greta", "Helena", "Ingrid", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    "name_m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
}
# First letter and count of the letters of a script and case, as code points.
SCRIPTS = {"latin": (0x61, 26, 0x41, 26), "greek": (0x3B1, 25, 0x391, 17), "cyrillic": (0x430, 32, 0x410, 32)}
# Telephone country codes of one and two digits; others have three.
SHORT_CODES = ["1", "7"]
MIDDLE_CODES = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]
KEY = "sparkmill"
#: Draws in an entity's own length, and draws at all.
MOST_ROUNDS, LAST_ROUND = 8, 40

ANY = "|".join(KINDS.values())
OPEN, CLOSE, ESCAPE = "﷐", "﷑", "﷒"


def kind_of(entity: Column, before: Column) -> Column:
    """By what stands before it, else the first kind whose pattern matches the whole entity."""
    out = F.when(F.lower(before).rlike(SECRET_AFTER + "$"), "secret")
    for kind, titles in TITLES.items():
        out = out.when(before.rlike(rf"\b(?:{titles})\.? $"), kind)
    for kind, pattern in KINDS.items():
        out = out.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("secret")


def canonical(kind: Column, entity: Column) -> Column:
    """The entity without punctuation, and without case where case doesn't matter."""
    bare = F.regexp_replace(entity, r"[ \-().]", "")
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("ipv4", "secret", "access_key"), entity).otherwise(bare)


def number(key: str, kind: Column, of: Column, attempt: Column, at: Column) -> Column:
    """A keyed number below 2**32."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), at.cast("string"), of), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def redrawn(key: str, kind: Column, entity: Column, of: Column, attempt: Column, keep: Column) -> Column:
    """entity with each letter and digit after the first `keep` drawn anew; the n-th letter or digit depends on n only, not on punctuation."""
    chars = F.split(entity, "")
    hexadecimal = of.rlike("^[0-9a-f]{8,}$")

    def char(c: Column, i: Column) -> Column:
        n = number(key, kind, of, attempt, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), r"[^\p{L}\p{N}]", "")))
        out = F.when(i < keep, c).when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(hexadecimal & c.rlike("^[a-f]$"), F.char(97 + n % 6))
        for low, count, high, capitals in SCRIPTS.values():
            code = F.ascii(c)
            out = out.when(code.between(low, low + count - 1), F.decode(F.unhex(F.lpad(F.hex(low + n % count), 4, "0")), "UTF-16BE"))
            out = out.when(code.between(high, high + capitals - 1), F.decode(F.unhex(F.lpad(F.hex(high + n % capitals), 4, "0")), "UTF-16BE"))
        return out.when(c.rlike(r"^\p{Ll}$"), F.char(97 + n % 26)).when(c.rlike(r"^\p{Lu}$"), F.char(65 + n % 26)).otherwise(c)

    return F.array_join(F.transform(chars, char), "")


def luhn_sum(digits: Column) -> Column:
    """The check sum of a string of digits, the last of which isn't doubled."""
    values = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v)


def iban_checked(iban: Column) -> Column:
    """iban with the check digits, its third and fourth, that make it valid: 98 less the remainder by 97 of the rest, letters counting from 10 on."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), lambda r, v: (F.when(v > 9, r * 100 + v).otherwise(r * 10 + v) % 97).cast("int"))
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))


def country_length(phone: Column) -> Column:
    """How many characters of a telephone number its plus sign and country code are, by its digits alone, however it is punctuated."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    length = F.when(F.substring(digits, 1, 1).isin(SHORT_CODES), 1).when(F.substring(digits, 1, 2).isin(MIDDLE_CODES), 2).otherwise(3)
    return F.when(length == 1, F.length(F.regexp_extract(phone, r"^\+\d", 0))).when(length == 2, F.length(F.regexp_extract(phone, r"^\+\d[^0-9]*\d", 0))).otherwise(F.length(F.regexp_extract(phone, r"^\+\d[^0-9]*\d[^0-9]*\d", 0)))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    of = canonical(kind, entity)
    draw = lambda keep, what=entity: redrawn(key, kind, what, of, attempt, keep)
    octet = lambda i: (F.lit(1) + number(key, kind, of, attempt, F.lit(i)) % 254).cast("string")
    drawn = draw(F.lit(1))
    digits = F.regexp_replace(drawn, "[^0-9]", "")
    fixed = F.concat(F.regexp_replace(drawn, "[0-9]$", ""), ((F.lit(10) - luhn_sum(F.concat(F.regexp_replace(digits, "[0-9]$", ""), F.lit("0"))) % 10) % 10).cast("string"))
    valid = luhn_sum(F.regexp_replace(entity, "[^0-9]", "")) % 10 == 0
    top = F.concat(F.lit("."), F.element_at(F.split(entity, r"\."), -1))
    head = F.regexp_replace(entity, r"\.[^.@]+$", "")
    letter = lambda i: F.char(97 + number(key, kind, of, attempt, -i) % 26)
    more = F.when(attempt < MOST_ROUNDS, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(MOST_ROUNDS), F.greatest(attempt, F.lit(MOST_ROUNDS))), letter), ""))
    out = F.when(kind == "email", F.concat(more, draw(F.lit(0), head), top)).when(kind == "secret", F.concat(draw(F.lit(0)), more))
    out = out.when(kind == "ipv4", F.concat_ws(".", *[octet(i) for i in range(4)]))
    out = out.when(kind == "access_key", draw(F.lit(4))).when(kind == "iban", iban_checked(draw(F.lit(2))))
    out = out.when((kind == "card") & valid, fixed).when(kind == "card", drawn)
    out = out.when(kind == "phone", draw(country_length(entity)))
    for name, names in NAMES.items():
        listed = F.array(*map(F.lit, names))
        parts = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(listed, (number(key, kind, of, attempt, i) % len(names) + 1).cast("int")))  # noqa: B023
        out = out.when(kind == name, F.initcap(F.array_join(parts, "")))
    return out.otherwise(draw(F.lit(0)))


def pieces_of(text: Column) -> Column:
    """The text split at its entities, which are at the odd places. Characters that mark the places are escaped where a text has them itself."""
    own = text.rlike(f"[{OPEN}{CLOSE}{ESCAPE}]")
    escaped = F.replace(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}2")), F.lit(OPEN), F.lit(f"{ESCAPE}0")), F.lit(CLOSE), F.lit(f"{ESCAPE}1"))
    marked = F.regexp_replace(F.when(own, escaped).otherwise(text), rf"((?i:\b{SECRET_AFTER}))([A-Za-z0-9_\-/+.]{{8,}})", f"$1{OPEN}$2{CLOSE}")
    marked = F.regexp_replace(marked, rf"\b((?:{'|'.join(TITLES.values())})\.? )(\p{{Lu}}\p{{Ll}}+)", f"$1{OPEN}$2{CLOSE}")
    return F.split(F.regexp_replace(marked, f"(?:{ANY})", f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that hold entities: their columns, _pieces, and _found, the kind and the text of each entity in order."""
    likely = F.col(text_col).rlike(SIGNS)
    # written once: what follows refers to the pieces many times
    rows = written(docs.where(likely).withColumn("_pieces", pieces_of(F.col(text_col))), "pii-pieces")
    at = F.sequence(F.lit(1), F.size("_pieces") - 1, F.lit(2))
    before = lambda i: F.substring(F.element_at("_pieces", i.cast("int")), -24, 24)
    found = F.transform(at, lambda i: F.struct(kind_of(F.element_at("_pieces", (i + 1).cast("int")), before(i)).alias("kind"), F.element_at("_pieces", (i + 1).cast("int")).alias("entity")))
    return rows.withColumn("_found", F.when(F.size("_pieces") > 1, found))


def redraws(found: DataFrame, key: str = KEY) -> DataFrame | None:
    """kind, canonical, attempt of the entities whose first surrogate clashes; None where none does."""
    # what must differ: names do from names of either gender
    space = F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")).alias("space")
    distinct = written(found.select("kind", canonical(F.col("kind"), F.col("entity")).alias("canonical")).distinct(), "pii-entities")
    state = distinct.withColumn("attempt", F.lit(0))
    own = distinct.select(space, F.col("canonical").alias("c"))
    for _ in range(LAST_ROUND):
        drawn = written(state.withColumn("c", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key))).withColumn("space", space), "pii-drawn")
        first = drawn.groupBy("space", "c").agg(F.min(F.struct("canonical", "kind")).alias("keeps"), F.count("*").alias("n"))
        clash = drawn.join(first.where("n > 1"), ["space", "c"]).where(F.struct("canonical", "kind") != F.col("keeps")).select("kind", "canonical").union(drawn.join(own, ["space", "c"], "left_semi").select("kind", "canonical")).distinct()
        clash = written(clash, "pii-clashes")
        if clash.isEmpty():
            break
        state = drawn.join(clash.withColumn("again", F.lit(1)), ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    else:
        raise RuntimeError(f"surrogates still clash after {LAST_ROUND} draws")
    again = written(state.where("attempt > 0"), "pii-redraws")
    return None if again.isEmpty() else again


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with text_col's entities replaced, n_entities, and kinds (how many of each kind)."""
    plain = docs.select(*[c for c in docs.columns if c not in ("n_entities", "kinds")])
    rows = entities(plain, id_col, text_col)
    listed = rows.select(F.explode("_found").alias("e")).select("e.kind", "e.entity")
    again = redraws(listed, key)
    rows = rows.withColumn("_digest", F.xxhash64(text_col))
    if again is not None:
        each = rows.select(id_col, "_digest", F.explode("_found").alias("e")).select(id_col, "_digest", "e.kind", canonical(F.col("e.kind"), F.col("e.entity")).alias("canonical")).distinct()
        by_doc = each.join(again, ["kind", "canonical"]).groupBy(id_col, "_digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canonical"), "attempt"))).alias("_again"))
        rows = rows.join(by_doc, [id_col, "_digest"], "left")
    else:
        rows = rows.withColumn("_again", F.lit(None).cast("map<string,int>"))
    attempt = lambda e: F.coalesce(F.element_at("_again", F.concat_ws("|", e.kind, canonical(e.kind, e.entity))), F.lit(0))
    made = F.transform("_found", lambda e: surrogate(e.kind, e.entity, attempt(e), key))
    rows = rows.withColumn("_made", made)
    mixed = F.array_join(F.transform("_pieces", lambda p, i: F.when(i % 2 == 0, p).otherwise(F.element_at("_made", ((i + 1) / 2).cast("int")))), "")
    own = F.col(text_col).rlike(f"[{OPEN}{CLOSE}{ESCAPE}]")
    back = F.replace(F.replace(F.replace(mixed, F.lit(f"{ESCAPE}1"), F.lit(CLOSE)), F.lit(f"{ESCAPE}0"), F.lit(OPEN)), F.lit(f"{ESCAPE}2"), F.lit(ESCAPE))
    counted = F.transform(F.array_sort(F.array_distinct(F.transform("_found", lambda e: e.kind))), lambda k: F.struct(k.alias("key"), F.size(F.filter("_found", lambda e: e.kind == k)).alias("value")))
    text = F.when(F.col("_made").isNull(), F.col(text_col)).when(own, back).otherwise(mixed)
    replaced = rows.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in plain.columns), F.greatest(F.coalesce(F.size("_found"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.map_from_entries(counted), F.expr("map()").cast("map<string,int>")).alias("kinds")
    )
    rest = plain.where(~F.coalesce(F.col(text_col).rlike(SIGNS), F.lit(False))).withColumn("n_entities", F.lit(0).cast("long")).withColumn("kinds", F.expr("map()").cast("map<string,int>"))
    return replaced.union(rest)
