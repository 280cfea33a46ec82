"""Scalar text functions as columns; only Unicode normalisation needs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REGIONS = {"toc": 0.3, "header_footer": 0.3, "footnote": 0.45, "references": 0.6, "metadata": 0.6}
INTENTS = {
    "definition": r"\b(what is|define|definition|meaning of)\b",
    "numeric": r"\b(how many|how much|percent|ratio|number of)\b|%",
    "date": r"\b(when|date|year|deadline)\b",
    "cause": r"\b(why|because|cause|reason)\b",
    "comparison": r"\b(compare|versus|vs|difference)\b",
    "overview": r"\b(overview|summary|summarize|outline)\b",
}
TAGS = {
    "definition": r"\b(is defined as|means|refers to)\b",
    "trend": r"\b(increase|decrease|rise|fall|grow)\w*\b",
    "comparison": r"\b(than|compared|versus)\b",
    "cause": r"\b(because|therefore|due to)\b",
    "numeric": r"[0-9]",
    "date": r"\b(19|20)[0-9]{2}\b",
    "table": r"\|",
}
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?[ ]*(?:%|percent)?"


def normalized(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no normal form: {form}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run(text)


def search_form(text: Column) -> Column:
    """NFKC and case folding, for comparison."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return run(text)


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def retrieval_text(text: Column) -> Column:
    """Without page comments; no white space at line ends and at both ends."""
    plain = F.regexp_replace(text, r"(?is)<!--\s*page(?:-header|-footer)?:.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", ""))


def hits(text: Column, needle: str) -> Column:
    """Number of occurrences of ``needle``, none overlapping another, case aside."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def snippet(text: Column, needle: str, around: int = 40) -> Column:
    """``around`` characters on both sides of the first occurrence, white space as single spaces."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(needle) + around, F.length(text) + 1)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start), r"\s+", " "))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, marked)


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur in the text, joined by commas, in the patterns' order."""
    low = F.lower(text)
    return F.concat_ws(",", *[F.when(low.rlike(p), F.lit(n)) for n, p in patterns.items()])


def region(path: Column) -> Column:
    """Region of a block by its heading path; the first rule that holds."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"table of contents|^contents$"), "toc").when(low.rlike(r"metadata"), "metadata").when(low.rlike(r"footnote"), "footnote")
        .when(low.rlike(r"header|footer"), "header_footer").when(low.rlike(r"references|bibliography|works cited"), "references").when(low.rlike(r"appendix"), "appendix").otherwise("body")
    )


def region_weight(name: Column) -> Column:
    out = F.lit(1.0)
    for k, v in REGIONS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def numbers(text: Column) -> Column:
    """Numeric values in the text, white space aside."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda x: F.replace(x, F.lit(" "), F.lit("")))


def boundary(text: Column, most: int) -> Column:
    """Where to cut a text at ``most`` characters: after the last sentence end or line in them, or there."""
    head = F.substring(text, 1, most)
    last = F.length(F.regexp_extract(head, r"^((?s:.*)(?:[.!?](?=\s|$)|\n))", 1))
    return F.when(F.length(text) <= most, F.length(text)).when(last > 0, last).otherwise(F.lit(most))


def read_chars(chars: Column) -> Column:
    return F.least(F.lit(3000), F.greatest(F.lit(800), chars))


def needs_next(text: Column) -> Column:
    """Whether a block goes on: a table, or no sentence end."""
    return text.contains("|") | ~F.substring(F.rtrim(text), -1, 1).isin(*".!?。！？")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex digits of a digest of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def script(text: Column) -> Column:
    """Latin, Han, Mixed or Unknown, by the letters that occur."""
    latin, han = text.rlike(r"[A-Za-zÀ-ɏ]"), text.rlike(r"[一-鿿]")
    return F.when(latin & han, "Mixed").when(han, "Han").when(latin, "Latin").otherwise("Unknown")
