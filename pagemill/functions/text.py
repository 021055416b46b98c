"""Text: symbols, truncation, words, names of files, levels of confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import IMAGE_SUFFIXES, SYMBOLS


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def special(c: Column) -> Column:
    """Text that holds one of the symbols, or speaks of conformity."""
    hit = F.contains(F.lower(c), F.lit("conformity"))
    for symbol, _ in SYMBOLS:
        hit = hit | F.contains(c, F.lit(symbol))
    return hit


def standardized(c: Column) -> Column:
    """Special text with its symbols written out; other text unchanged."""
    out = c
    for symbol, name in SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(name))
    return F.when(special(c), out).otherwise(c)


def cell_text(c: Column) -> Column:
    """Null as empty, line breaks as spaces, stripped."""
    return stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def suffix(path: Column) -> Column:
    """Lower-case suffix of a file name with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]+$", "")


def input_kind(path: Column) -> Column:
    """pdf, image, or an error for any other suffix."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGE_SUFFIXES), "image").otherwise(F.raise_error(F.concat(F.lit("unsupported input: "), path)))


def page_name(document: Column, page: Column, kind: str) -> Column:
    return F.format_string(f"%s_page_%03d_{kind}.png", document, page)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.9, "very_high").when(c >= 0.8, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("very_low")


def document_class(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], reach: int = 4000) -> Column:
    """The first class one of whose words stands in the text's first characters (the classifier's limit), else Other."""
    seen = F.lower(F.substring(text, 1, reach))
    out = F.lit("Other")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(seen, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out
