"""Column functions on tokens, semi-structured responses and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of an evidence token, of a number, of a note's header, of a mask, the end of a sentence; the bounds of
# weights; the replaced pronouns.
TOKEN = r"^(E_\d+)(?:_@_(.+))?$"
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
HEADER = r"(?m)^([A-Z][A-Za-z /\-]{3,40}):"
MASK = r"_{2,}"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(])"
BOUND, LOW, HIGH = 7.0, 1e-3, 1e3
PRONOUNS = [("yourself", "themselves"), ("your", "their"), ("you", "they")]

#: White space at the ends that is stripped.
SPACE = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def token_code(token: Column) -> Column:
    """The code of a token; null if malformed."""
    return F.nullif(F.regexp_extract(token, TOKEN, 1), F.lit(""))


def token_value(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, TOKEN, 2), F.lit(""))


def shown(value: Column, meanings: Column) -> Column:
    """A value's meaning, itself without one, ``present`` for null."""
    return F.when(value.isNull(), F.lit("present")).otherwise(F.coalesce(F.try_element_at(meanings, value), value))


def depersonalised(text: Column) -> Column:
    """The reader's pronouns become the patient's."""
    for word, new in PRONOUNS:
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", new)
    return text


def capital(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def bullets(phrases: Column) -> Column:
    return F.array_join(F.transform(phrases, lambda p: F.concat(F.lit("- "), capital(p))), "\n")


def sentences_of_three(phrases: Column, subject: str = "The patient") -> Column:
    """Phrases in their order, three to a sentence that begins with the subject; empty without phrases."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(phrases) / 3) - 1).cast("int"))
    one = lambda i: F.concat(F.lit(f"{subject} "), F.array_join(F.slice(phrases, 3 * i + 1, 3), "; "), F.lit("."))
    return F.when(F.size(phrases) > 0, F.array_join(F.transform(starts, one), " ")).otherwise(F.when(phrases.isNotNull(), F.lit("")))


def leading_value(text: Column, key: str) -> Column:
    """What the first JSON object of a text has under key, as JSON text; null if there is no object, if it does not
    close or parse, or if it has no such key (or null there). What follows the object is ignored."""
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substr(text, start))
    return F.from_json(rest, f"`{key}` string")[key]


def number_list(raw: Column) -> Column:
    """The numbers of a JSON array; an entry that is none is null, as is what is no array."""
    return F.transform(F.from_json(raw, "array<string>"), lambda x: x.try_cast("double"))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def numbers_after_bracket(text: Column, n: int) -> Column:
    """The first n numbers after the first bracket; null if there are fewer."""
    rest = F.regexp_extract(text, r"(?s)\[(.*)$", 1)
    found = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(found) >= n, F.slice(found, 1, n))


def probabilities(text: Column, n: int, salvage: bool = True, key: str = "probabilities") -> Column:
    """n probabilities of a response, clipped at 0 and scaled; all zero gives uniform.

    They are those of its first JSON object. If that does not close or parse, or has no such key, they are the first n
    numbers after the first bracket. Another number of entries, or one that is no finite number, gives null.
    """
    from tallyloom.functions.vectors import normalised

    raw = leading_value(text, key)
    rescued = numbers_after_bracket(text, n) if salvage else F.lit(None).cast("array<double>")
    values = F.when(raw.isNotNull(), number_list(raw)).otherwise(rescued)
    return F.when((F.size(values) == n) & all_finite(values), normalised(values))


def weights(values: Column, kind: str, bands: dict[str, float] | None = None) -> Column:
    """Log ratios of ``numeric`` ratios (null if one is not positive), ``logodds``, or words for bands; held to +-7.

    values: numbers, or for ``ordinal`` words. One entry that is null, not finite or an unknown word makes all null.
    """
    if kind == "ordinal":
        table = F.create_map(*[F.lit(x) for kv in (bands or {}).items() for x in kv])
        got = F.transform(values, lambda v: F.try_element_at(table, v))
    elif kind == "numeric":
        got = F.transform(values, lambda v: F.when((v > 0) & (v < float("inf")), F.ln(F.least(F.greatest(v, F.lit(LOW)), F.lit(HIGH)))))
    else:
        got = F.transform(values, lambda v: v.cast("double"))
    return F.when(all_finite(got), F.transform(got, lambda v: F.least(F.greatest(v, F.lit(-BOUND)), F.lit(BOUND))))


def weights_in(text: Column, n: int, kind: str = "numeric", bands: dict[str, float] | None = None, key: str = "weights") -> Column:
    """The n log ratios of a response's first JSON object, by weights; null for another number of them. Nothing is salvaged."""
    raw = leading_value(text, key)
    values = F.from_json(raw, "array<string>") if kind == "ordinal" else number_list(raw)
    return F.when(F.size(values) == n, weights(values, kind, bands))


def index_in(text: Column, n: int, key: str = "index") -> Column:
    """The number under key, cut to an integer; null outside [0, n)."""
    i = leading_value(text, key).try_cast("double").cast("int")
    return F.when((i >= 0) & (i < n), i)


def after_last(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, -1)


def nearest_band(x: Column, bands: dict[str, float]) -> Column:
    """The name whose value is nearest; the earlier one among equals."""
    options = F.array(*[F.struct(F.abs(x - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(bands.items())])
    return F.array_min(options)["k"]


def numeric_target(x: Column) -> Column:
    return F.round(F.least(F.greatest(F.exp(F.least(F.greatest(x, F.lit(-BOUND)), F.lit(BOUND))), F.lit(LOW)), F.lit(HIGH)), 4)


def held(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(-BOUND)), F.lit(BOUND))


def logodds_target(x: Column) -> Column:
    """A log ratio held to +-7, with three digits."""
    return F.round(held(x), 3)


def ordinal_target(x: Column, bands: dict[str, float]) -> Column:
    """The name of the band nearest to a log ratio held to +-7."""
    return nearest_band(held(x), bands)


def sections(note: Column, header: str = HEADER) -> Column:
    """Map of a note's headers to the text below them; the last of equal headers counts."""
    heads = F.transform(F.regexp_extract_all(note, F.lit(header), F.lit(1)), stripped)
    bodies = F.transform(F.slice(F.split(note, header, -1), F.lit(2), F.greatest(F.size(heads), F.lit(1))), stripped)
    kept = F.filter(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda z: z["h"].isNotNull())
    names = F.array_distinct(F.transform(kept, lambda z: z["h"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(kept, lambda z: z["h"] == n), -1)["b"]))


def segments(body: Column, least: int = 25, most: int = 400) -> Column:
    """Sentences of a body by length; lines are joined first."""
    flat = stripped(F.regexp_replace(body, r"\s*\n\s*", " "))
    return F.filter(F.transform(F.split(flat, SENTENCE_END, -1), stripped), lambda s: F.length(s).between(least, most))


def mask_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MASK))


def mask_density(text: Column) -> Column:
    """Runs of underscores for each word."""
    return mask_count(text) / F.greatest(F.size(F.split(stripped(text), r"\s+", -1)), F.lit(1))


def one_line(text: Column, most: int = 200) -> Column:
    """White space collapsed, and the first ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, most)
