"""Column functions over text, all built in. Null in, null out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafquire.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def squash_cover(c: Column) -> Column:
    """Without white space, bars and dashes, as coverage compares."""
    return F.regexp_replace(c, r"(?U)[\s|\-]+", "")


def match_key(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def strip_number(c: Column) -> Column:
    """A title without its one leading number."""
    return F.regexp_replace(strip(c), P.LEADING_NUMBER, "")


def normalize(c: Column) -> Column:
    """A contents title without white space and trailing leader dots."""
    return F.regexp_replace(squash(c), f"[{P.DOTS}]+$", "")


def clean_cell(c: Column) -> Column:
    """A table cell: null is empty, white space folded and trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({P.WORD})"), 1)


def bigrams(word: Column) -> Column:
    """The overlapping two-letter pieces of a word; a single letter stays."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    return F.when(F.length(word) < 2, F.array(word)).otherwise(pieces)


def grams(c: Column) -> Column:
    """A text's index terms in order, case folded; positions run on over words."""
    return F.flatten(F.transform(words(F.lower(F.coalesce(c, F.lit("")))), bigrams))


def content_words(query: Column) -> Column:
    """The words that are no question words, or all words if none is left."""
    every = words(query)
    kept = F.filter(every, lambda w: ~w.isin(P.STOPWORDS))
    return F.when(F.size(kept) == 0, every).otherwise(kept)


def phrases(query: Column) -> Column:
    """A query's phrases: the terms of each content word."""
    return F.transform(content_words(F.coalesce(query, F.lit(""))), lambda w: bigrams(F.lower(w)))


def level_of(title: Column, rules=P.LEVELS["chapter"]) -> Column:
    """Level of the first rule that matches a title; null if none does."""
    text = strip(title)
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(level)) for pattern, level in rules])


def level_by_rules(title: Column, rules: Column) -> Column:
    """The same with the rules in a column of ``array<struct<pattern, level>>``."""
    text = strip(title)
    return F.get(F.filter(rules, lambda r: F.regexp_like(text, r["pattern"])), F.lit(0))["level"]


def printed_page(page: Column, offset: Column) -> Column:
    """The printed number of a page; null in front matter."""
    return F.when(page - offset >= 1, page - offset)


def embedding_text(short_title: Column, path: Column, body: Column) -> Column:
    return F.concat(F.lit("["), short_title, F.lit("] "), F.array_join(path, " > "), F.lit("\n"), body)


def citation(start: Column, end: Column) -> Column:
    """Page span of a section: one page, a range, or front matter."""
    one = F.concat(F.lit("p"), start.cast("string"))
    return F.when(start.isNull(), P.FRONT).when(start.eqNullSafe(end), one).otherwise(
        F.concat(one, F.lit("~"), F.coalesce(end.cast("string"), F.lit("None")))
    )


def resolve(name: Column, aliases: Column) -> Column:
    """A name, or what a map of aliases has for it."""
    return F.coalesce(F.try_element_at(aliases, name), name)


def truncate(c: Column, limit: int = P.SNIPPET_CHARS) -> Column:
    """``struct<text, cut>``: at most ``limit`` characters, trimmed at the right if cut."""
    cut = F.length(c) > limit
    return F.struct(F.when(cut, F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", "")).otherwise(c).alias("text"), cut.alias("cut"))


def tokens(c: Column) -> Column:
    """Estimated tokens, rounding halves to even."""
    return F.bround(F.length(c) / F.lit(P.CHARS_PER_TOKEN)).cast("long")


def unit(vector: Column) -> Column:
    """A vector at length one; a zero vector becomes null."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def markdown(rows: Column, residual: Column, width: Column | None = None) -> Column:
    """A table's rows as markdown, padded to the widest, with the residual lines below.

    For long tables ``width``, the widest row's, should be a column: else it is looked for again at each row.
    """
    width = F.array_max(F.transform(rows, F.size)) if width is None else width
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(pad(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    rest = F.when(F.size(residual) > 0, F.concat(F.array(F.lit("")), residual)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), body, rest), "\n")


def form_text(name: Column, appendix: Column, number: Column, start: Column, end: Column) -> Column:
    return F.format_string(P.FORM_RECORD, name, appendix, number, start, end)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
