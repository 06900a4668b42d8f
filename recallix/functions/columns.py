"""Scalar behaviours as Column expressions: all built-in functions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a constants.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def fields(text: Column) -> Column:
    """Words divided by white space, without empty ones, in order and with repeats."""
    return F.array_remove(F.split(text, r"\s+"), "")


def word_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and underscores, in order and with repeats."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_]+", " ")), " "), "")


def token_set(text: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(word_tokens(text), lambda w: F.length(w) >= least))


def mixed_tokens(text: Column) -> Column:
    """ASCII words of two characters or more and single Han characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{2,}|\p{IsHan}"), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the size of the larger set; 0 if one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a non-empty word, as a long."""
    digits = F.hex(F.encode(word, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long")))


def lexical_score(query: Column, text: Column) -> Column:
    """1 if the whole query is a substring of the text, else the share of its words that are; lower case."""
    q, t = F.lower(F.trim(query)), F.lower(text)
    parts = fields(q)
    hits = F.size(F.filter(parts, lambda p: F.contains(t, p)))
    return F.when((q == "") | (t == ""), 0.0).when(F.contains(t, q), 1.0).otherwise(hits / F.size(parts))


def cold_lexical_score(query: Column, content: Column, summary: Column) -> Column:
    """1 if content or summary holds the query, else the share of its words that equal a word of the content."""
    q, text = F.lower(query), F.lower(content)
    parts, words = fields(q), fields(text)
    hits = F.size(F.filter(parts, lambda p: F.array_contains(words, p)))
    whole = F.contains(text, q) | F.contains(F.lower(summary), q)
    return F.when(F.trim(q) == "", 0.0).when(whole, 1.0).otherwise(hits / F.size(parts))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norm == 0, 0.0).otherwise(inner_product(a, b) / norm)


def recency_share(version: Column, latest: Column) -> Column:
    return F.when((latest <= 0) | (version <= 0), 0.0).when(version >= latest, 1.0).otherwise(version / latest)


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days; timestamps without zone are taken as UTC."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def object_type(object_id: Column) -> Column:
    """The type that an id's prefix stands for; memory if it is unknown."""
    starts = lambda *ps: _any([object_id.startswith(p) for p in ps])
    return F.when(starts("mem_", "summary_", "shared_"), "memory").when(starts("evt_"), "event").when(starts("state_"), "agent_state").when(starts("art_", "tool_trace_"), "artifact").when(starts("edge_"), "edge").otherwise("memory")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def polarity(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "true", "1", "confirm", "agree"), "positive").when(t.isin("no", "false", "0", "deny", "disagree", "never"), "negative").otherwise("neutral")


def space_out(text: Column) -> Column:
    """Every character apart, existing white space dropped: the second try of a query in Han script."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"(.)", "$1 "))


def state_id(*parts: Column) -> Column:
    return F.concat(F.lit("state_"), F.substring(F.sha2(F.concat_ws("\0", *(F.trim(p) for p in parts)), 256), 1, 24))
