"""Personal data: found, masked, replaced."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mask

# Patterns of personal data, in the order in which they are replaced. Letter case does not count.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+33|0)\s*[1-9](?:[\s.-]*\d{2}){4}\b",
    "ssn": r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b",
    "address": r"\b\d{1,4}\s(?:rue|avenue|boulevard|place|chemin|impasse)\b",
    "credit_card": r"\b(?:\d{4}[\s-]?){3}\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}\s?(?:\d{4}\s?){4,7}\d{1,4}\b",
}
TYPES = tuple(PATTERNS)


def found(text: Column, kind: str) -> Column:
    """All matches of one kind, as they stand."""
    return F.regexp_extract_all(text, F.lit("(?i)" + PATTERNS[kind]), F.lit(0))


def anonymize(text: Column, kinds: tuple[str, ...] = TYPES) -> Column:
    """Every match replaced by [PII], one kind after another."""
    for kind in kinds:
        text = F.regexp_replace(text, "(?i)" + PATTERNS[kind], "[PII]")
    return text


def has_pii(text: Column, kinds: tuple[str, ...] = TYPES) -> Column:
    out = F.lit(False)
    for kind in kinds:
        out = out | text.rlike("(?i)" + PATTERNS[kind])
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = TYPES) -> DataFrame:
    """(id_col, pii_type, masked): a row for each match."""
    each = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.transform(found(F.col(text_col), k), mask).alias("values")) for k in kinds])
    rows = docs.select(id_col, F.explode(each).alias("x")).select(id_col, "x.pii_type", F.explode("x.values").alias("masked"))
    return rows


def detect_spans(kinds: tuple[str, ...] = TYPES):
    """A pandas UDF: array of (pii_type, value masked, start, end) in the order of kinds, then of places. Spark has no places of matches."""
    compiled = {k: re.compile(PATTERNS[k], re.IGNORECASE) for k in kinds}

    def hide(v: str) -> str:
        return "***" if len(v) <= 4 else f"{v[:3]}***{v[-2:]}"

    @F.pandas_udf("array<struct<pii_type:string,value:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pii_type": k, "value": hide(m.group()), "start": m.start(), "end": m.end()} for k, p in compiled.items() for m in p.finditer(t or "")])

    return spans


def apply_action(docs: DataFrame, action: str, text_col: str = "text", kinds: tuple[str, ...] = TYPES) -> DataFrame:
    """warn: adds has_pii; anonymize: replaces in the text; exclude: drops the rows with personal data."""
    if action == "warn":
        return docs.withColumn("has_pii", F.coalesce(has_pii(F.col(text_col), kinds), F.lit(False)))
    if action == "anonymize":
        return docs.withColumn(text_col, anonymize(F.col(text_col), kinds))
    if action == "exclude":
        return docs.where(~F.coalesce(has_pii(F.col(text_col), kinds), F.lit(False)))
    raise ValueError(f"unknown action: {action}")
