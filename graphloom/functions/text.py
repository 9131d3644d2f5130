"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that neither begin nor end a candidate phrase.
STOPWORDS = """a about all an and any are as at be been between both but by can connected connection connections do does each entities entity find for
from give graph has have how in is it its link linked links list many me most node nodes of on or path relationship relationships show that the their
there these they this to type types what when where which who why with""".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str, fallback: Column | str | None = "") -> Column:
    """White space to single spaces, trimmed; what is then empty or null becomes the fallback."""
    out = F.nullif(F.trim(F.regexp_replace(_c(x).cast("string"), r"\s+", " ")), F.lit(""))
    return F.coalesce(out, F.lit(fallback) if not isinstance(fallback, Column) else fallback)


def attribute(attrs: Column | str, *keys: str) -> Column:
    """The value of the first key that is present, even if it is blank."""
    out = F.when(F.map_contains_key(_c(attrs), keys[0]), F.element_at(_c(attrs), keys[0]))
    for k in keys[1:]:
        out = out.when(F.map_contains_key(_c(attrs), k), F.element_at(_c(attrs), k))
    return out


def is_true(x: Column | str) -> Column:
    """Booleans that travelled as text."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))) == "true", F.lit(False))


def predicate_name(x: Column | str) -> Column:
    """Anything but letters and digits to _, none at the ends, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(_c(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


#: Fixed value: a bare quantity or date.
QUANTITY = r"(?i)^(?:UAH|USD|EUR|GBP)?\s*\d[\d\s.,/-]*\s*(?:%|million|billion|thousand|MW|kV|minutes|hours|days|years)?$"


def is_quantity(x: Column | str) -> Column:
    return F.coalesce(F.trim(_c(x)).rlike(QUANTITY), F.lit(False))


def document_names(attrs: Column | str, sources: Column | None = None) -> Column:
    """Distinct names of the documents that a record cites, the single one first."""
    single = F.array(clean_text(attribute(attrs, "source_document", "doc_id"), None))
    text = F.array(F.element_at(_c(attrs), "sources"))
    many = text if sources is None else F.coalesce(sources, text, F.array(F.lit(None).cast("string")))
    cleaned = F.transform(F.concat(single, many), lambda n: clean_text(n, None))
    return F.array_distinct(F.filter(cleaned, lambda n: n.isNotNull()))


def candidate_phrases(question: Column | str, limit: int = 40) -> Column:
    """Quoted spans, then word windows of four down to one that neither begin nor end with a stopword; distinct."""
    q = _c(question)
    quoted = F.regexp_extract_all(q, F.lit("[\"']([^\"']{2,100})[\"']"), F.lit(1))
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_'&.\-]+"), F.lit(0))
    parts = [quoted]
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    for size in (4, 3, 2, 1):
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        windows = F.transform(starts, lambda i: F.slice(words, i, F.lit(size)))  # noqa: B023
        open_ends = F.filter(windows, lambda w: ~F.array_contains(stop, F.lower(F.element_at(w, 1))) & ~F.array_contains(stop, F.lower(F.element_at(w, -1))))
        parts.append(F.filter(F.transform(open_ends, lambda w: F.array_join(w, " ")), lambda p: F.length(p) >= 3))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, limit)


def occurrences(text: Column | str, term: Column | str) -> Column:
    """How often the term stands in the text, side by side; 0 for an empty term."""
    t, x = _c(text), _c(term)
    return F.when(F.length(x) > 0, ((F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)).cast("long")).otherwise(F.lit(0).cast("long"))


def excerpt_words(text: Column | str, start: Column, end: Column, around: int = 25) -> Column:
    """The span (code points from 0) with so many words on each side, and an ellipsis where there are more."""
    t = _c(text)
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    left, span, right = words(F.substring(t, F.lit(1), start)), words(F.substring(t, start + 1, end - start)), words(F.substring(t, end + 1, F.length(t)))
    parts = F.concat(F.slice(left, F.greatest(F.size(left) - around + 1, F.lit(1)), F.lit(around)), span, F.slice(right, F.lit(1), F.lit(around)))
    out = F.concat(F.when(F.size(left) > around, "…").otherwise(""), F.array_join(parts, " "), F.when(F.size(right) > around, "…").otherwise(""))
    return F.when(start.isNull() | end.isNull() | t.isNull() | (t == ""), F.lit("")).otherwise(out)


def excerpt_chars(text: Column | str, start: Column, end: Column, around: int = 180) -> Column:
    """The span with so many characters on each side, without the word that an edge cuts, white space collapsed."""
    t = _c(text)
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(t))
    body = F.substring(t, low + 1, high - low)
    body = F.when(low > 0, F.regexp_replace(body, "^[^ ]* ", "")).otherwise(body)
    body = F.when(high < F.length(t), F.regexp_replace(body, " [^ ]*$", "")).otherwise(body)
    out = F.concat(F.when(low > 0, "…").otherwise(""), clean_text(body), F.when(high < F.length(t), "…").otherwise(""))
    return F.when(start.isNull() | end.isNull() | t.isNull() | (t == ""), F.lit("")).otherwise(out)


def tolerant_pattern(quote: Column | str) -> Column:
    """A pattern that finds a quotation however its white space runs."""
    words = F.filter(F.split(F.trim(_c(quote)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), r"\s+")


def coerce(value: Column | str, kind: Column | str) -> Column:
    """A typed attribute in its canonical text; what does not parse stays as it is, and empty is null."""
    v, k = F.nullif(F.trim(_c(value)), F.lit("")), _c(kind)
    return (F.when(k.isin("int", "long"), F.coalesce(v.try_cast("long").cast("string"), v))
            .when(k.isin("float", "double"), F.coalesce(v.try_cast("double").cast("string"), v))
            .when(k == "boolean", F.lower(v).isin("true", "1", "yes").cast("string")).otherwise(v))


def band(value: Column | str) -> Column:
    """Five bands of a value from 0 to 1."""
    v = _c(value)
    return F.when(v.isNull(), None).when(v >= 0.8, "very high").when(v >= 0.6, "high").when(v >= 0.4, "moderate").when(v >= 0.2, "low").otherwise("very low")


def capped(value: Column | str, cap: float) -> Column:
    """The value over a fixed cap, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value) / F.lit(float(cap)))) if cap > 0 else F.lit(0.0)
