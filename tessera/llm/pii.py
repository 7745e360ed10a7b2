"""Surrogates for personal data, in DataFrame functions alone.

`detect` finds entities with one pattern of alternatives, in order of their place. Each is named by its kind and its
canonical form (lower case, digits alone for numbers). Its surrogate is a keyed function of kind and canonical form, so
that the same entity gets the same surrogate in every document, on every executor and in every run with the same key:

- e-mail addresses: local part and domain are replaced separately, so that addresses of one domain keep sharing one;
- phone, card and account numbers, keys, passwords and tokens: each character by one of its own class (digit, lower- or
  upper-case letter, and within hexadecimal strings a hexadecimal one); country codes, separators and prefixes stay, a
  card keeps its first digit and whether its check digit holds;
- network addresses: octets within 1 to 254, or hexadecimal characters by others;
- names behind a title or a known given name: given names by given names of the same gender and script, surnames by
  surnames of the same script, so that "Mr Smith" and "John Smith" stay one person.

Collisions. `surrogates` checks all entities of the table: no two get the same surrogate, and no surrogate is an entity
of the table. Whoever loses draws again, with the next variant, until none is left; variants beyond 0 are kept in a
table of exceptions, which is empty for all but the smallest name spaces and large tables.

Defined results: a null text stays null, an empty one empty; texts without entities stay as they are. Rows are changed
one by one, so that repeated rows and ids repeat their result. Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut_lineage, free

#: Rounds of drawing again for those that collide. Each leaves a small share of the ones before.
MOST_ROUNDS = 40
#: Exceptions that go into the plan as they are; more of them are joined.
FEW = 500

# Titles by gender, given names by script and gender, and syllables of which surnames are made.
TITLES = {
    "male": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "any": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "male"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Carlos", "Pierre", "Hans", "Peter", "Paul", "Lukas", "Javier", "Antoine", "Stefan", "Daniel", "Henry", "George", "Luis", "Miguel", "Nicolas", "Klaus", "Felix"),
    ("latin", "female"): ("Mary", "Patricia", "Linda", "Barbara", "Elizabeth", "Susan", "Sarah", "Karen", "Maria", "Claire", "Sophie", "Anna", "Julia", "Carmen", "Lucia", "Ingrid", "Emma", "Olivia", "Laura", "Marie", "Hannah", "Sabine", "Camille", "Priya"),
    ("cyrillic", "male"): ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Николай", "Олег", "Виктор"),
    ("cyrillic", "female"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Вера", "Нина"),
}
SYLLABLES = {
    "latin": ("bar", "cor", "dan", "fel", "gar", "hol", "ker", "lan", "mor", "nel", "par", "ros", "sal", "tor", "ver", "wil"),
    "cyrillic": ("бар", "вол", "гор", "дан", "кор", "лев", "мор", "нов", "пет", "рос", "сав", "тар", "фед", "чер", "шар", "яр"),
}

_NAME = r"\p{Lu}\p{Ll}++(?:[-'’]\p{Lu}\p{Ll}++)?"
_TITLE = "|".join(sorted({t for group in TITLES.values() for t in group}, key=len, reverse=True))
_GIVEN = "|".join(sorted({n for group in GIVEN.values() for n in group}, key=len, reverse=True))
_FIRST = "".join(sorted({n[0] for group in (*TITLES.values(), *GIVEN.values()) for n in group}))
_SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)"
_HEX = "[0-9A-Fa-f]{1,4}"
# Calling codes of one and two digits (all others have three); words behind a title that make no name of it.
CALLING = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NO_NAMES = ("Analyst", "Architect", "Consultant", "Designer", "Developer", "Director", "Engineer", "Manager", "Pepper", "Scientist", "Universe", "World")
_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Kind and pattern; the first that fits at a place wins. Each begins with a look at one character, so that most places cost no more.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.\p{L}{2,}"),
    ("secret", rf"(?=[pPtTsSaA]){_SECRET}\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{{8,}}={{0,2}}"),
    ("key", r"(?=A)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("iban", r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b"),
    ("phone", r"\(\d{3}\) ?\d{3}-\d{4}\b"),
    # Without a country code, as written in French and Spanish, and in German and English.
    ("phone", r"(?=[0679])(?<![\d.,:/-])(?<!\d )(?:0[1-9](?:[ .-]\d\d){4}|[679]\d\d(?: \d\d){3}|0\d{2,4}(?:[ /-]\d{6,8}|[ -]\d{3,4}[ -]\d{3,4}))(?![ .:/-]?\d)"),
    ("ip6", rf"(?=[0-9A-Fa-f])(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]{{0,3}}\d)[0-9A-Fa-f]{{3,4}}:(?:{_HEX}:){{0,5}}(?::{_HEX}){{1,6}})(?![\w:])"),
    ("ip", rf"(?=\d)(?<!ersion )(?<!elease )\b(?:{_BYTE}\.){{3}}{_BYTE}\b"),
    ("ssn", r"(?=\d)\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"(?=\d)\b\d{3}[ .-]\d{3}[ .-]\d{4}\b"),
    ("card", r"(?=\d)\b\d{4}(?:[ -]\d{4}){3}\b|(?=\d)\b\d{13,19}\b"),
    ("person", rf"(?=[{_FIRST}])\b(?:(?:{_TITLE})\b\.?[ \u00A0](?!(?:{"|".join(NO_NAMES)})\b){_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME}\b)"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text that has neither of these has no entity: the long pattern looks at few texts.
_HINTS = ("[0-9@=:]", rf"(?=[{_FIRST}])\b(?:{_TITLE}|{_GIVEN})\b")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once: in a lambda, Spark would work it out again at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(entity: Column) -> Column:
    found = F.lit("person")
    for kind, pattern in reversed(PATTERNS[:-1]):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def detect(text: Column) -> Column:
    """The entities of a text in order, as array<string>."""
    return F.when(text.rlike(_HINTS[0]) | text.rlike(_HINTS[1]), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)), 512)


def _number(digest: Column, k: Column | int, below: Column | int) -> Column:
    """A number below `below`, from the k-th group of four hexadecimal digits of a digest of 32 groups."""
    at = (F.lit(k) if isinstance(k, int) else k) % 32 * 4 + 1
    return F.pmod(F.conv(F.substr(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int"), F.lit(below) if isinstance(below, int) else below)


def _same_classes(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """`text` with each digit and letter replaced by another of its class. What stands between them doesn't matter."""

    def pick(of: str, n: Column) -> Column:
        return F.substr(F.lit(of), (F.pmod(n, F.lit(len(of))) + 1).cast("int"), F.lit(1))

    def drawn(c: Column, n: Column) -> Column:
        lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return (
            F.when(c.between("0", "9"), pick("0123456789", n))
            .when(hexadecimal & c.between("a", "f"), pick(lower[:6], n))
            .when(hexadecimal & c.between("A", "F"), pick(upper[:6], n))
            .when(c.rlike(r"^\p{Ll}$"), pick(lower, n))
            .when(c.rlike(r"^\p{Lu}$"), pick(upper, n))
            .otherwise(c)
        )

    def one(c: Column, at: Column) -> Column:
        k = F.length(F.regexp_replace(F.substr(text, F.lit(1), at + 1), r"[^\p{L}\p{N}]", ""))
        # A long text uses the digest's groups again, shifted by how often it has been through.
        return let(k, lambda k: let(_number(digest, k, 65536) + F.floor(k / 32).cast("int") * 7919, lambda n: drawn(c, n)))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """The check sum, modulo 10, of a string of digits whose last is the check digit."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10


def _mod97(account: Column) -> Column:
    """The remainder by 97 of an account number with its first four characters behind the others and letters as 10 to 35: 1 if its check holds."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4))), "")
    values = F.transform(F.filter(turned, lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda rest, v: F.pmod(rest * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _put_digits(form: Column, digits: Column) -> Column:
    """`form` with its digits, in order, replaced by those of `digits`."""
    parts = F.split(form, "")
    before = F.transform(parts, lambda c, k: F.length(F.regexp_replace(F.substr(form, F.lit(1), k + 1), r"\D", "")))
    return F.array_join(F.zip_with(parts, before, lambda c, n: F.when(c.between("0", "9"), F.substr(digits, n, F.lit(1))).otherwise(c)), "")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(name: Column) -> Column:
    found = F.lit("any")
    for gender in ("male", "female"):
        titles, names = "|".join(TITLES[gender]), "|".join(n for (_, g), group in GIVEN.items() if g == gender for n in group)
        found = F.when(name.rlike(rf"^(?:(?:{titles})\b|(?:{names}) )") | name.rlike(rf"^\S+ (?:{names}) "), gender).otherwise(found)
    return found


def _listed(options: Mapping[str, tuple[str, ...]], of: Column) -> Column:
    """The options of this name, the first ones if there are none of it."""
    found = F.array(*map(F.lit, next(iter(options.values()))))
    for name, values in options.items():
        found = F.when(of == name, F.array(*map(F.lit, values))).otherwise(found)
    return found


def _pick(options: Column, n: Column) -> Column:
    return F.element_at(options, (F.pmod(n, F.size(options)) + 1).cast("int"))


def _surname(script: Column, digest: Column, variant: Column) -> Column:
    """Three syllables, and one more for each draw after the first."""
    places = F.sequence(F.lit(8), F.lit(10) + variant)
    return let(_listed(SYLLABLES, script), lambda of: F.initcap(F.array_join(F.transform(places, lambda k: _pick(of, _number(digest, k, 65536))), "")))


def _given(script: Column, gender: Column, digest: Column, variant: Column) -> Column:
    """A name of this script and gender, and one more for each draw after the first."""
    names = _listed({f"{s}:{g}": values for (s, g), values in GIVEN.items()}, F.concat_ws(":", script, gender))
    places = F.sequence(F.lit(4), F.lit(4) + variant)
    return let(names, lambda of: F.array_join(F.transform(places, lambda k: _pick(of, _number(digest, k, 65536))), "-"))


def parts_of(entity: Column) -> Column:
    """An entity as array<struct<kind, form, ahead>>: what is replaced, each form behind the text `ahead` of it, which stays.

    Most entities are one part. An address has its local part and its domain, a person given name and surname.
    """

    def part(kind: Column | str, form: Column, ahead: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), form.alias("form"), ahead.alias("ahead"))

    def rest_of(form: Column) -> Column:
        return F.substr(entity, F.lit(1), F.length(entity) - F.length(form))

    nothing = F.lit("")
    name = F.regexp_replace(entity, rf"^(?:{_TITLE})\b\.?[  ]", "")
    words = F.split(name, " ")
    gender, script = _gender(entity), _script(entity)
    surname = F.concat_ws(":", F.lit("surname"), script)
    full = F.array(part(F.concat_ws(":", F.lit("given"), script, gender), words[0], rest_of(name)), part(surname, F.element_at(words, -1), F.lit(" ")))
    person = F.when(F.size(words) > 1, full).otherwise(F.array(part(surname, name, rest_of(name))))
    address = F.array(part("local", F.substring_index(entity, "@", 1), nothing), part("domain", F.substring_index(entity, "@", -1), F.lit("@")))
    value = F.regexp_extract(entity, r"[=:]\s*[\"']?(.*)$", 1)
    by_kind = lambda kind: F.when(kind == "person", person).when(kind == "email", address).when(kind == "secret", F.array(part("secret", value, rest_of(value)))).otherwise(F.array(part(kind, entity, nothing)))
    return let(kind_of(entity), by_kind)


def canonical(kind: Column, form: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(form, r"\D", "")).when(kind.isin("iban"), F.replace(form, F.lit(" "), F.lit(""))).when(kind.isin("secret", "key"), form).otherwise(F.lower(form))


def surrogate(kind: Column, form: Column, variant: Column, key: str) -> Column:
    """The surrogate of one part: its format is that of `form`, its content depends on key, kind, canonical form and variant."""
    return let(_digest(key, kind, canonical(kind, form), variant.cast("string")), lambda digest: _drawn(kind, form, variant, digest))


def _drawn(kind: Column, form: Column, variant: Column, digest: Column) -> Column:
    """What stays at the front of the form, and the rest with each character replaced, put together by kind."""
    digits = F.regexp_replace(form, r"\D", "")
    # A calling code goes by the list, whatever stands behind it, so that a number's forms keep the same one; else the trunk zero stays.
    country = F.regexp_extract(form, rf"^({CALLING}|0)", 1)
    front = F.when(kind == "phone", country).when(kind == "iban", F.left(form, F.lit(2))).when(kind == "key", F.left(form, F.lit(4))).when(kind == "card", F.left(digits, F.lit(1))).otherwise(F.lit(""))
    body = F.when(kind == "card", F.substr(digits, F.lit(2), F.length(digits) - 2)).when(kind == "domain", F.substring_index(form, ".", 1)).otherwise(F.substr(form, F.length(front) + 1))
    hexadecimal = (kind == "ip6") | (kind == "secret") & (form.rlike(r"^[0-9a-f]+$") | form.rlike(r"^[0-9A-F]+$"))
    letters = F.translate(F.substr(digest, F.lit(97), F.lit(6)), "0123456789abcdef", "abcdefghijklmnop")
    split_kind = F.split(kind, ":")
    script, gender = F.get(split_kind, F.lit(1)), F.get(split_kind, F.lit(2))
    gender = F.when(gender == "any", F.when(_number(digest, 0, 2) == 0, "male").otherwise("female")).otherwise(gender)

    def checked(body: Column) -> Column:
        off = F.when(_luhn_sum(digits) == 0, F.lit(0)).otherwise(_number(digest, 31, 9) + 1)
        check = F.pmod(F.lit(20) - _luhn_sum(F.concat(body, F.lit("0"))) + off, F.lit(10))
        return let(F.concat(body, check.cast("string")), lambda d: _put_digits(form, d))

    def iban(changed: Column) -> Column:
        holds = _mod97(F.replace(form, F.lit(" "), F.lit(""))) == 1
        rest = F.substr(changed, F.lit(5))
        check = F.lit(98) - _mod97(F.concat(F.left(form, F.lit(2)), F.lit("00"), F.replace(rest, F.lit(" "), F.lit(""))))
        # A check that did not hold does not hold afterwards either.
        check = F.when(holds, check).otherwise(F.pmod(check - 2 + 1 + _number(digest, 31, 95), F.lit(97)) + 2)
        return F.concat(F.left(form, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), rest)

    def together(changed: Column) -> Column:
        return (
            F.when(kind == "card", checked(changed))
            .when(kind == "iban", iban(changed))
            .when(kind == "domain", F.concat_ws(".", changed, letters, F.lit("example")))
            # Short forms have few others of their kind; after some draws they grow.
            .when((variant > 4) & kind.isin("local", "secret"), F.concat(changed, letters))
            .otherwise(changed)
        )

    other = let(F.concat(front, _same_classes(body, digest, hexadecimal)), together)
    return (
        F.when(kind == "ip", F.concat_ws(".", *(_number(digest, k, 254) + 1 for k in range(4))))
        .when(kind.startswith("given"), _given(script, gender, digest, variant))
        .when(kind.startswith("surname"), _surname(script, digest, variant))
        .otherwise(other)
    )


def exceptions(entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, variant) of the parts whose first surrogate is not theirs alone; None if there are none.

    `entities`: (kind, form) of all parts found. Every round, of those that draw the same surrogate the first by
    canonical form keeps it, unless an earlier round's or an entity of the table has it; the others draw again. If some
    still collide after MOST_ROUNDS rounds, a name space is too small for its entities, and an error is raised.
    """
    group = F.substring_index("kind", ":", 2)
    parts = entities.select("kind", "form", canonical(F.col("kind"), F.col("form")).alias("canon"), group.alias("space"))
    parts = cut_lineage(parts.groupBy("kind", "canon", "space").agg(F.min("form").alias("form")))
    # A given name alone tells nobody apart: it may be another person's.
    real = parts.where(~F.col("space").startswith("given")).select("space", F.col("canon").alias("drawn_canon"))
    open_, held = parts.withColumn("variant", F.lit(0)), None
    for _ in range(MOST_ROUNDS):
        drawn = canonical(F.col("kind"), surrogate(F.col("kind"), F.col("form"), F.col("variant"), key))
        drawn = open_.withColumn("drawn_canon", drawn)
        winners = drawn.groupBy("space", "drawn_canon").agg(F.min(F.struct("kind", "canon")).alias("winner"))
        taken = real if held is None else real.unionByName(held.select("space", "drawn_canon"))
        free = winners.join(taken, ["space", "drawn_canon"], "left_anti").select(F.col("winner.kind").alias("kind"), F.col("winner.canon").alias("canon"), "drawn_canon")
        won = drawn.join(free, ["kind", "canon", "drawn_canon"], "left_semi")
        lost = cut_lineage(drawn.join(free, ["kind", "canon", "drawn_canon"], "left_anti").withColumn("variant", F.col("variant") + 1).drop("drawn_canon"))
        if lost.isEmpty():
            return None if held is None else cut_lineage(held.unionByName(won)).where("variant > 0").select("kind", "canon", "variant")
        held = cut_lineage(won if held is None else held.unionByName(won))
        open_ = lost
    raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} rounds")


def _replaced(entity: Column, variants: Column | None, key: str) -> Column:
    def one(p: Column) -> Column:
        variant = F.lit(0)
        if variants is not None:
            variant = F.coalesce(F.element_at(variants, F.concat_ws("|", p["kind"], canonical(p["kind"], p["form"]))), variant)
        return F.concat(p["ahead"], surrogate(p["kind"], p["form"], variant, key))

    return F.array_join(F.transform(parts_of(entity), one), "")


def replace(docs: DataFrame, key: str, text_col: str = "text", checked: bool = True) -> DataFrame:
    """`docs` with the entities of `text_col` replaced and, as the last column, `pii_entities`, array<struct<kind, found, by>>, in order.

    `key`: a secret; who has it can repeat the draws. Where `docs` has a column pii_entities, the new one gets underscores ahead.

    `checked`: look for collisions among all entities first, which reads the texts twice.
    """
    listed, by_col, variants_col, entities_col = (free(docs, c) for c in ("_entities", "_by", "_variants", "pii_entities"))
    found = docs.withColumn(listed, detect(F.col(text_col)))
    variants = None
    if checked:
        parts = docs.select(F.explode(detect(F.col(text_col))).alias("entity")).distinct().select(F.inline(parts_of(F.col("entity"))))
        collided = exceptions(parts, key)
        if collided is not None:
            few = collided.limit(FEW + 1).collect()
            if len(few) <= FEW:
                names, numbers = [f"{r['kind']}|{r['canon']}" for r in few], [r["variant"] for r in few]
                variants = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, numbers)))
            else:
                found = _with_variants(found, collided, listed, variants_col)
                variants = F.col(variants_col)
    by = F.transform(listed, lambda e: _replaced(e, variants, key))
    found = found.withColumn(by_col, F.when(F.size(listed) > 0, by).otherwise(F.array().cast("array<string>")))
    between = F.split(F.col(text_col), PATTERN, -1)
    text = F.array_join(F.zip_with(between, F.col(by_col), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    entities = F.zip_with(listed, by_col, lambda e, b: F.struct(kind_of(e).alias("kind"), e.alias("found"), b.alias("by")))
    found = found.withColumn(entities_col, entities)
    return found.withColumn(text_col, F.when(F.size(listed) > 0, text).otherwise(F.col(text_col))).drop(listed, by_col, variants_col)


def _with_variants(found: DataFrame, collided: DataFrame, listed: str, variants_col: str) -> DataFrame:
    """`found` with `variants_col`, a map of the exceptions among a row's entities. Rows meet them by their list of entities."""
    lists = found.where(F.size(listed) > 0).select(F.col(listed).alias("list")).distinct()
    parts = lists.select("list", F.explode("list").alias("entity")).select("list", F.inline(parts_of(F.col("entity"))))
    parts = parts.select("list", "kind", canonical(F.col("kind"), F.col("form")).alias("canon")).distinct()
    own = free(found, "_list")
    maps = parts.join(collided, ["kind", "canon"]).groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "variant"))).alias(variants_col)).withColumnRenamed("list", own)
    joined = found.where(F.size(listed) > 0).join(maps, F.col(listed) == F.col(own), "left").drop(own)
    return joined.unionByName(found.where(F.coalesce(F.size(listed), F.lit(0)) <= 0).withColumn(variants_col, F.lit(None).cast("map<string,int>")))
