"""Text expressions: normalisation, tokens, sentences, ids. All are Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() of Python sees it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])[\"')\]]?" + BLANK + r"+|\n+"
METRIC_SENTENCE_END = r"[.!?。！？\n]+"
SNIPPET_CHARS = 240


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts joined by U+001F. Null parts count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def embedding_text(context: Column, text: Column) -> Column:
    """What is indexed: the context and a blank line before the text, where there is a context."""
    return F.when(F.coalesce(F.length(context), F.lit(0)) > 0, F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def content_words(text: Column) -> Column:
    """Words of more than one character."""
    return F.filter(words(text), lambda w: F.length(w) > 1)


def blank_tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    return F.size(blank_tokens(text))


def _pieces(text: Column, pattern: str) -> Column:
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda s: F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(cut, lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences, ended by . ! ? (and a closing quote or bracket) before white space, or by line ends."""
    return _pieces(text, SENTENCE_END)


def metric_sentences(text: Column) -> Column:
    """Sentences of the metrics: cut at every . ! ? (full-width ones too) and line end."""
    return _pieces(text, METRIC_SENTENCE_END)


def compressor_sentences(text: Column) -> Column:
    """Sentences of the compressor: cut at white space after . ! ?."""
    return F.filter(F.split(F.trim(text), rf"(?<=[.!?]){BLANK}+"), lambda s: F.trim(s) != "")


def grams(text: Column, n: int) -> Column:
    """Different runs of n characters of a text, found in one pass; n 0: one empty run."""
    if n == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """Collapsed text; over `most` characters its beginning and an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def contains_ignoring_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of set a that is in b; empty a: 0."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
