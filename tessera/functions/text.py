"""Scalar helpers on text, labels, numbers, hashes and ids, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "yes", "y", "1")


def is_missing(value: Column) -> Column:
    """Null, or a string of white space."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def present(value: Column) -> Column:
    return ~is_missing(value)


def truthy(value: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """Whether the trimmed, lower-case value is one of the words; which words count differs by caller."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*words), F.lit(False))


def squeeze(text: Column) -> Column:
    """No-break spaces as spaces, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


def label(value: Column, default: str = "") -> Column:
    return F.when(is_missing(value), F.lit(default)).otherwise(F.trim(value.cast("string")))


def same_label(a: Column, b: Column) -> Column:
    """Equality of labels without regard to case and spacing; missing equals missing."""
    both = is_missing(a) & is_missing(b)
    return both | F.coalesce(F.lower(squeeze(a.cast("string"))) == F.lower(squeeze(b.cast("string"))), F.lit(False))


def first_present(*values: Column) -> Column:
    return F.coalesce(*(F.when(present(v), F.trim(v.cast("string"))) for v in values))


def record_key(*ids: Column, prefixes: tuple[str, ...] = ("CR_", "HT_")) -> Column:
    """The first id that is there, without the prefixes of derived records."""
    return F.regexp_replace(first_present(*ids), f"^(?:{'|'.join(prefixes)})", "")


def canonical_json(**columns: Column) -> Column:
    """A JSON object with its keys in order and nulls kept: equal contents give equal strings."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """The prefix and the first hexadecimal digits, upper-case, of SHA-256 over the parts as a JSON array of strings."""
    payload = F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit(prefix), F.upper(F.substr(F.sha2(payload, 256), F.lit(1), F.lit(length))))


def sampling_key(seed: Column | str | int, value: Column) -> Column:
    """A hash that orders rows as if at random, the same in every run with this seed."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("\n", seed, value.cast("string")), 256)


def hash_bucket(value: Column, buckets: int = 4) -> Column:
    """SHA-256 of the value modulo `buckets`, a power of two up to 16: the last hexadecimal digit decides."""
    return F.pmod(F.conv(F.right(F.sha2(value.cast("string"), 256), F.lit(1)), 16, 10).cast("int"), F.lit(buckets))


def hash_share(value: Column) -> Column:
    """SHA-256 of the value as a number from 0 to 1, by its first 13 hexadecimal digits."""
    return F.conv(F.substr(F.sha2(value.cast("string"), 256), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(16**13))


def number(text: Column) -> Column:
    """The first number in a text, else null. Commas between thousands are left out."""
    found = F.regexp_extract(F.regexp_replace(text.cast("string"), r"(?<=\d),(?=\d{3})", ""), r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0)
    return F.when(found != "", found.try_cast("double"))


def yes_no(value: Column) -> Column:
    """yes, no, unclear or missing."""
    v = F.lower(F.trim(value.cast("string")))
    lacking = is_missing(value) | v.isin("none", "null", "nan", "n/a")
    stated = v.isin("yes", "y", "true", "present", "reported", "performed", "confirmed", "detected", "available") | (v.try_cast("double") != 0)
    denied = v.isin("no", "n", "false", "absent", "not reported", "not performed", "not detected", "unavailable") | (v.try_cast("double") == 0)
    return F.when(lacking, "missing").when(F.coalesce(stated, F.lit(False)), "yes").when(F.coalesce(denied, F.lit(False)), "no").otherwise("unclear")


def labels(value: Column) -> Column:
    """Labels from a JSON array or a list with commas, semicolons or bars: trimmed, distinct, in order."""
    parsed = F.from_json(value, "array<string>")
    parts = F.when(F.trim(value).startswith("["), parsed).otherwise(F.split(value, r"[,;|]"))
    return F.coalesce(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def doi(value: Column) -> Column:
    """A DOI in lower case without resolver, prefix, brackets and closing punctuation; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[<(\[{]+", ""), r"[>\]}.,;]+$", "")
    # A round bracket at the end belongs to the DOI if it was opened there.
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("("))) < F.length(bare) - F.length(F.replace(bare, F.lit(")")))
    bare = F.when(opened, F.regexp_replace(bare, r"[).,;]+$", "")).otherwise(bare)
    return F.when(bare.startswith("10."), bare)


def excerpt(text: Column, limit: int, mark: str = "[truncated]") -> Column:
    """The text, or as much of it as leaves room for a line with the mark within `limit` characters."""
    kept = F.concat(F.substr(text, F.lit(1), F.lit(max(limit - len(mark) - 1, 0))), F.lit(f"\n{mark}"))
    return F.when(F.length(text) <= limit, text).otherwise(kept)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row; inside a lambda, an expression would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_ahead(numbers: Column, chunk: int = 32) -> Column:
    """For each element of an array the sum of those ahead of it.

    Arrays have no running fold: sums are made of chunks, then over the chunks ahead, then within a chunk, so that the work is
    a small multiple of the length and no row has to be taken apart.
    """

    def add(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n)

    def own(i: Column) -> Column:
        return F.floor(i / chunk).cast("int")

    def of_chunks(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), own(F.size(n))), lambda k: add(F.slice(n, k * chunk + 1, F.lit(chunk))))

    def of_bases(n: Column, bases: Column) -> Column:
        return F.transform(n, lambda _, i: F.get(bases, own(i)) + add(F.slice(n, own(i) * chunk + 1, i - own(i) * chunk)))

    def of_numbers(n: Column) -> Column:
        return let(of_chunks(n), lambda chunks: let(F.transform(chunks, lambda _, k: add(F.slice(chunks, F.lit(1), k))), lambda bases: of_bases(n, bases)))

    return let(F.transform(numbers, lambda n: n.cast("long")), of_numbers)


def pieces(text: Column, separator: str) -> Column:
    """What a separator parts, as array<struct<start, text>>; start is in characters, and empty pieces stay."""

    def of_parts(parts: Column, gaps: Column) -> Column:
        lengths = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0)))
        return F.zip_with(sums_ahead(lengths), parts, lambda at, p: F.struct(at.alias("start"), p.alias("text")))

    return let(F.split(text, separator, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(separator), F.lit(0)), lambda gaps: of_parts(parts, gaps)))


def reportable(value: Column) -> Column:
    """A value as struct<status, value>: reported, missing (blank or unresolved) or not_reported (absent or said to be so)."""
    v = F.lower(F.trim(value.cast("string")))
    status = F.when(value.isNull() | v.isin("null", "none", "not available", "not reported", "n/a"), "not_reported").when((v == "") | v.isin("unresolved"), "missing").otherwise("reported")
    return F.struct(status.alias("status"), F.when(status == "reported", value.cast("string")).alias("value"))
