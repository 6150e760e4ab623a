"""Operator 8, PII: surrogate generation with keyed, type-consistent replacements.

One pattern of alternatives finds the entities. Each distinct entity gets a surrogate by a keyed permutation of its format
(a Feistel network over HMACs): digits for digits and letters for letters of the same script, names of the same gender,
check digits that hold if they held. Distinct entities stay distinct, which a grouped check confirms; equal ones, however
written, stay equal across documents and runs. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.shared import stored, table

#: The session's setting that holds the key of ``query``, and the key that it takes for the synthetic tables where none is set.
SETTING, TEST_KEY = "spark.tarn.pii.key", "a key for synthetic tables"
#: Rounds of the Feistel network, characters that it permutes at a time, and entities that a task replaces.
ROUNDS, PIECE, PER_TASK = 4, 64, 1_000
#: What precedes a name, by gender.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"), "": ("Dr", "Prof")}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "James Peter Thomas Martin Daniel Oliver Simon Felix Julian Victor Hugo Oscar Marco Adrian Bruno Leon".split(),
    ("latin", "f"): "Anna Clara Maria Julia Laura Helen Alice Sophie Martha Emma Nora Vera Irene Paula Diana Rosa".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Олег Борис Антон".split(),
    ("cyrillic", "f"): "Анна Ольга Мария Ирина Вера Нина".split(),
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Ανδρέας".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα".split(),
}
#: Endings of given names that aren't on the lists, by script and gender; no listed name has one.
ENDINGS = {
    ("latin", "m"): "iko", ("latin", "f"): "ika", ("latin", ""): "ani", ("cyrillic", "m"): "имир", ("cyrillic", "f"): "иана", ("cyrillic", ""): "ей",
    ("greek", "m"): "άκης", ("greek", "f"): "ούλα", ("greek", ""): "ις",
}
#: Letters and digits that stand in for each other.
ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñßšžćčđłńřśźďťňģķļș", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ",
    "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
#: Repeats without a bound are of single characters: Java runs through those in a loop, but recurs once for each repeat of a group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?!(?:(?:19|20)[0-9]{2}[ .-]){2}(?:19|20)[0-9]{2}(?![0-9]))(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])(?! ?-?[0-9]{4})",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"\b(?:{_TITLE})\.?[ ]+{_NAME}(?:[ ]+{_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has, for a quick look.
_HINT = rf"[@0-9]|\b(?:{_TITLE})\b"


def kind_of(raw: Column) -> Column:
    """The first pattern that the whole of ``raw`` fits."""
    return reduce(lambda out, k: F.when(raw.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out), reversed(list(PATTERNS)), F.lit("card"))


def script_of(raw: Column) -> Column:
    return F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").when(raw.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(raw: Column) -> Column:
    """By title, else by a given name of the lists, else empty."""
    said = reduce(lambda out, g: F.when(raw.rlike(rf"^(?:{'|'.join(TITLES[g])})\b"), g).otherwise(out), ["f", "m"], F.lit(""))
    given = F.regexp_extract(raw, rf"^(?:{_TITLE})\.?[ ]+({_NAME})", 1)
    named = reduce(lambda out, k: F.when(given.isin(*GIVEN[k]), k[1]).otherwise(out), list(GIVEN), F.lit(""))
    return F.when(said != "", said).otherwise(named)


def parts_of(kind: Column, raw: Column) -> Column:
    """``array<struct<part, norm>>``: what an entity consists of. Emails are a local part and a domain, names a given and a
    family name; the rest is one part, without its separators, so that other spellings of it are the same. A phone number with
    a country code is another one than without."""
    low = F.lower(raw)
    one = lambda part, norm: F.struct(part.alias("part"), norm.alias("norm"))
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    tokens = F.split(F.regexp_replace(raw, rf"^(?:{_TITLE})\.?[ ]+", ""), "[ ]+")
    script, gender = script_of(raw), gender_of(raw)
    family = one(F.concat(F.lit("family:"), script), F.lower(F.element_at(tokens, -1)))
    given = one(F.concat(F.lit("given:"), script, F.lit(":"), gender), F.lower(tokens[0]))
    code, number = F.regexp_extract(raw, r"^\+([0-9]{1,3})", 1), F.regexp_replace(F.regexp_replace(raw, r"^\+[0-9]{1,3}", ""), "[^0-9]", "")
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit("|"), number)).otherwise(number)
    plain = one(kind, F.when(kind == "ip", raw).when(kind == "phone", phone).otherwise(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")))
    return (
        F.when(kind == "email", F.array(one(F.lit("local"), F.concat(local, F.lit("@"), domain)), one(F.lit("domain"), domain)))
        .when((kind == "name") & (F.size(tokens) > 1), F.array(given, family))
        .when(kind == "name", F.array(family))
        .otherwise(F.array(plain))
    )


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 of a text as 128 hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha512(secret).digest() if len(secret) > 128 else secret).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def permuted(codes: Column, sizes: Column, tag: Column, key: str) -> Column:
    """Another array of numbers below ``sizes`` for one of such: a keyed permutation of all of them, without fixed points.

    Four rounds of a Feistel network add to the numbers in even places, then to those in odd ones, what the HMAC of the others says; then the
    last number that can change goes up by one, and the rounds are undone. Each step is a bijection, so different arrays of
    the same sizes stay different; that holds for a space of two values too. Numbers of size 0 stay.
    """
    last = F.array_max(F.transform(sizes, lambda n, i: F.when(n > 1, i)))

    def step(state: Column, k: Column) -> Column:
        turn, sign = F.when(k < ROUNDS, k).otherwise(2 * ROUNDS - k), F.when(k < ROUNDS, 1).otherwise(-1)
        others = F.array_join(F.transform(state, lambda v, i: F.when(i % 2 == turn % 2, "_").otherwise(v.cast("string"))), " ")
        said = _hmac(key, F.concat_ws("|", tag, turn.cast("string"), others))
        number = lambda h, i: F.conv(F.substr(h, (i * 4) % 121 + 1, F.lit(7)), 16, 10).cast("long")
        moved = lambda h: F.transform(state, lambda v, i: F.when((F.get(sizes, i) > 1) & (i % 2 == turn % 2), F.pmod(v + sign * number(h, i), F.get(sizes, i))).otherwise(v))
        turned = F.get(F.transform(F.array(said), moved), F.lit(0))
        return F.when(k == ROUNDS, F.transform(state, lambda v, i: F.when(i == last, (v + 1) % F.get(sizes, i)).otherwise(v))).otherwise(turned)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), codes, step)


def _spelled(norm: Column, tag: Column, key: str) -> Column:
    """``norm`` with its letters and digits permuted, each within its own alphabet: its format stays, and texts of one format
    stay different. Characters of no alphabet stay. A long one is permuted by pieces, so that its cost is linear."""
    pieces = F.regexp_extract_all(norm, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    made = F.array_join(F.transform(pieces, lambda p, i: _spelled_piece(p, F.when(i > 0, F.concat(tag, F.lit("|piece|"), i.cast("string"))).otherwise(tag), key)), "")
    return F.when(F.length(norm) > PIECE, made).otherwise(_spelled_piece(norm, tag, key))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, not at each place where a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spelled_piece(norm: Column, tag: Column, key: str) -> Column:
    alphabets = F.array(*map(F.lit, ALPHABETS))
    own = lambda c: F.coalesce(F.get(F.filter(alphabets, lambda a: F.call_function("instr", a, c) > 0), F.lit(0)), F.lit(""))

    def made(cs: Column) -> Column:
        codes = F.transform(cs, lambda e: F.greatest(F.call_function("instr", e.a, e.c) - 1, F.lit(0)).cast("long"))
        return _bound(F.struct(codes.alias("codes"), F.transform(cs, lambda e: F.length(e.a).cast("long")).alias("sizes")), lambda b: _bound(permuted(b.codes, b.sizes, tag, key), lambda out: spelled(cs, out)))

    def spelled(cs: Column, out: Column) -> Column:
        return F.array_join(F.transform(cs, lambda e, i: F.when(F.length(e.a) > 0, F.substr(e.a, (F.get(out, i) + 1).cast("int"), F.lit(1))).otherwise(e.c)), "")

    return F.when(norm == "", "").otherwise(_bound(F.transform(F.split(norm, ""), lambda c: F.struct(c.alias("c"), own(c).alias("a"))), made))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)


def luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it pass the Luhn test."""
    return F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits, as a number from 2 to 98, of an account number in a country."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return 98 - rest


def _following(names: list[str], key: str) -> dict[str, str]:
    """Each name's successor on the list, in an order that the key decides."""
    order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
    return {n.lower(): m.lower() for n, m in zip(order, order[1:] + order[:1], strict=True)}


def surrogate(part: Column, norm: Column, key: str) -> Column:
    """The replacement of a part: keyed, of its type, and different for different parts.

    Every kind is permuted within its format. A card keeps its first digit and its distance from the Luhn digit, so valid
    ones stay valid; an IBAN keeps its country and its distance from the right check digits; a phone number keeps its
    country code and the first digit after it; a domain keeps its last label; an address has four octets. A given name of the lists
    becomes another one of its script and gender; other given names are permuted and get an ending of theirs, which no
    listed name has.
    """
    size, at = F.length(norm), lambda a, n: F.substr(norm, a if isinstance(a, Column) else F.lit(a), n)
    body = F.when(size > 2, at(2, size - 2)).otherwise("")
    new_body = _spelled(body, F.concat(F.lit("card|"), at(1, F.lit(1))), key)
    first = at(1, F.lit(1))
    off = at(size, F.lit(1)).cast("int") - luhn_digit(F.concat(first, body))
    card = F.concat(first, new_body, F.pmod(luhn_digit(F.concat(first, new_body)) + off, F.lit(10)).cast("string"))

    country, check, account = at(1, F.lit(2)), at(3, F.lit(2)).cast("int"), at(5, size)
    new_account = _spelled(account, F.concat(F.lit("iban|"), country), key)
    iban = F.concat(country, F.lpad(F.pmod(iban_check(country, new_account) + check - iban_check(country, account), F.lit(100)).cast("string"), 2, "0"), new_account)

    kept = F.regexp_extract(norm, r"^(?:\+[0-9]+\|)?[0-9]", 0)
    phone = F.concat(kept, _spelled(F.substr(norm, F.length(kept) + 1, size), F.concat(F.lit("phone|"), kept), key))

    octets = F.transform(F.split(norm, r"\."), lambda x: x.cast("long"))
    ip = F.array_join(F.transform(permuted(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), F.lit("ip"), key), lambda x: x.cast("string")), ".")

    label = F.substring_index(norm, ".", -1)
    domain = F.concat(_spelled(at(1, size - F.length(label) - 1), F.lit("domain"), key), F.lit("."), label)
    local = _spelled(F.substring_index(norm, "@", 1), F.concat(F.lit("local|"), F.substring_index(norm, "@", -1)), key)

    listed = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        of = F.create_map(*[F.lit(x) for pair in _following(names, key).items() for x in pair])
        listed = F.when(part == f"given:{script}:{gender}", F.get(F.array(F.try_element_at(of, norm)), F.lit(0))).otherwise(listed)
    ending = F.create_map(*[F.lit(x) for (script, gender), e in ENDINGS.items() for x in (f"given:{script}:{gender}", e)])
    spelled = _spelled(norm, part, key)
    given = F.coalesce(listed, F.concat(spelled, F.element_at(ending, part)))
    made = {"card": card, "ip": ip, "iban": iban, "phone": phone, "domain": domain, "local": local}
    out = F.when(part.startswith("given:"), given).otherwise(spelled)
    for kind, column in made.items():
        out = F.when(part == kind, column).otherwise(out)
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``part, norm, surrogate`` for ``entities(part, norm)``: within a part no two are equal, and none is its own.

    Each is a function of the key and the entity alone, so later texts of the same entity agree, and no number of entities
    is too large. The check groups what was made; it raises if two entities share a surrogate. One that another entity
    has in the corpus can occur: in a space that the entities fill there is no other.
    """
    each = stored(entities.select("part", "norm").distinct())
    dealt = each.repartition(each.count() // PER_TASK + 1, "part", "norm")  # few bytes but much work: sizes alone would make one task
    made = stored(dealt.select("part", "norm", surrogate(F.col("part"), F.col("norm"), key).alias("surrogate")))
    whole = F.when(F.col("part") == "local", F.concat("surrogate", F.lit("@"), F.substring_index("norm", "@", -1))).otherwise(F.col("surrogate"))
    space = F.when(F.col("part").startswith("given:"), "given").otherwise(F.col("part"))
    twice = made.groupBy(space.alias("space"), whole.alias("whole")).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise RuntimeError(f"surrogates collide: {twice.first()}")
    return made


def _like(raw: Column, replaced: Column) -> Column:
    """``replaced`` written as ``raw`` is: its characters in the places of raw's letters and digits."""
    core = F.split(replaced, "")
    place = F.transform(F.split(raw, ""), lambda c: c.rlike("[A-Za-z0-9]").cast("int"))
    marked = F.arrays_zip(F.split(raw, "").alias("c"), place.alias("p"))
    out = F.aggregate(
        marked, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda a, e: F.struct(F.concat(a.s, F.when(e.p == 1, F.coalesce(F.get(core, a.n), F.lit(""))).otherwise(e.c)).alias("s"), (a.n + e.p).alias("n")),
    )
    return out["s"]


def _cased(raw: Column, replaced: Column) -> Column:
    """Capitals as in ``raw``: all, the first, or none."""
    capitals = ~raw.rlike(r"\p{Ll}") & raw.rlike(r"\p{Lu}\P{Lu}*\p{Lu}")
    return F.when(capitals, F.upper(replaced)).when(raw.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(replaced, 1, 1)), F.substr(replaced, F.lit(2), F.length(replaced)))).otherwise(replaced)


def _written(kind: Column, raw: Column, got: Column) -> Column:
    """The surrogate text of an entity from its parts' surrogates, in their order."""
    title = F.regexp_extract(raw, rf"^((?:{_TITLE})\.?[ ]+)", 1)
    tokens = F.split(F.regexp_replace(raw, rf"^(?:{_TITLE})\.?[ ]+", ""), "[ ]+")
    name = F.concat(title, F.array_join(F.zip_with(tokens, got, _cased), " "))
    return F.when(kind == "email", F.concat(got[0], F.lit("@"), F.get(got, F.lit(1)))).when(kind == "name", name).when(kind == "ip", got[0]).otherwise(_like(raw, F.regexp_replace(got[0], r"[+|]", "")))


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_entities, spans, text`` for every row of ``docs``: the text with surrogates in the entities' places.

    ``spans`` lists kind:start:end of the entities in the text as it was, in code points, ends exclusive. A text without
    entities, a null one too, stays as it is. Repeated rows get the same result; rows of one id and different texts are
    told apart. An empty table gives an empty result. Other columns are ignored. Texts without entities never leave their
    row; the others meet their surrogates by id and text hash.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    found = own.where(hinted).select("doc_id", "h", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("raws"), F.transform(F.split("text", ANY), F.length).alias("gaps")).where(F.size("raws") > 0)
    each = found.select("doc_id", "h", F.posexplode(F.arrays_zip("raws", F.slice("gaps", 1, F.size("raws")).alias("gaps"))).alias("at", "z")).select("doc_id", "h", "at", "z.raws", "z.gaps").distinct()
    upto = F.sum(F.col("gaps") + F.length("raws")).over(Window.partitionBy("doc_id", "h").orderBy("at"))  # within one text
    places = stored(each.select("doc_id", "h", "at", F.col("raws").alias("raw"), (upto - F.length("raws")).alias("start"), kind_of(F.col("raws")).alias("kind")))
    parts = places.select("kind", "raw").distinct().select("kind", "raw", F.posexplode(parts_of(F.col("kind"), F.col("raw"))).alias("nth", "p")).select("kind", "raw", "nth", "p.part", "p.norm")
    parts = stored(parts)
    made = surrogates(parts, key)
    written = parts.join(made, ["part", "norm"]).groupBy("kind", "raw").agg(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))).alias("g")).select("kind", "raw", _written(F.col("kind"), F.col("raw"), F.col("g.surrogate")).alias("new"))
    put = places.join(stored(written).select(F.col("raw").alias("of_raw"), F.col("kind").alias("of_kind"), "new"), (F.col("raw") == F.col("of_raw")) & (F.col("kind") == F.col("of_kind")))
    per_doc = stored(put.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "raw", "new", "start"))).alias("x")).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "x"))
    met = own.where(hinted).join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    gaps = F.split("text", ANY)
    spans = F.transform("x", lambda e: F.concat_ws(":", e.kind, e.start.cast("string"), (e.start + F.length(e.raw)).cast("string")))
    filled = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("x", i)["new"], F.lit("")))), "")
    shaped = met.select("doc_id", "text", "x", F.when(F.col("x").isNotNull(), gaps).alias("gaps"))
    some = F.col("x").isNotNull()
    replaced = shaped.select("doc_id", F.when(some, F.size("x")).otherwise(0).cast("long").alias("n_entities"), F.when(some, F.array_join(spans, ",")).otherwise("").alias("spans"), F.when(some, filled).otherwise(F.col("text")).alias("text"))
    return replaced.unionByName(own.where(~hinted).select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("spans"), "text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), spark.conf.get(SETTING, TEST_KEY))


SQL = None
