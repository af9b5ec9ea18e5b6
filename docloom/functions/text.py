"""Text functions over string columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Word of a text: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Runs without white space; the token count of a text is their number.
TOKEN = r"\S+"

# Words that are never keywords.
KEYWORD_STOPS = (
    "the a an and or but in on at to for of with by le la les un une des et ou mais dans sur à pour de avec par "
    "ce cette ces qui que quoi dont où is are was were be been"
).split()

# Stop words of the lexical search by language.
STOPS = {
    "english": "a an and are as at be by for from in is it of on or that the to was were with".split(),
    "french": (
        "a au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me meme mes moi mon ne nos notre nous "
        "on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous"
    ).split(),
}

# Names of the languages that have stop words.
LANGUAGES = {"french": ("fr", "fra", "fre", "french", "fr-fr", "fr_ca", "fr-ca"), "english": ("en", "eng", "english", "en-us", "en_us", "en-gb", "en_gb"), "auto": ("auto",)}

# Dollars for a million tokens in and out.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "claude-3-5-sonnet-20241022": (3.00, 15.00),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "mistral-large-latest": (2.00, 6.00),
    "mistral-small-latest": (0.20, 0.60),
}


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C. Spark has no function for it."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ"))


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preprocess(text: Column, normalize: bool = True, urls: bool = True, punctuation: bool = False, lowercase: bool = False) -> Column:
    """Text as it is compared and described: each step by its flag, white space always collapsed."""
    if normalize:
        text = nfc(text)
    if urls:
        text = F.regexp_replace(text, r"https?://\S+", " ")
    if punctuation:
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    if lowercase:
        text = F.lower(text)
    return collapse(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def truncate_tokens(text: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(tokens(text), F.lit(1), n.cast("int")), " ")


def shorten(text: Column, most: int, mark: str = "...", keep: int | None = None) -> Column:
    """``text``, or its first ``keep`` (``most``) characters and ``mark`` where it is longer than ``most``."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(keep or most)), F.lit(mark))).otherwise(text)


def title(given: Column) -> Column:
    return shorten(given, 160, keep=157)


def description(text: Column) -> Column:
    """The first two lines that are not blank, as one; null without such a line."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(lines) > 0, shorten(F.array_join(F.slice(lines, 1, 2), " "), 300, keep=297))


def valid_title(found: Column, stem: Column) -> Column:
    """``found`` if it can be a title: no binary rest, half letters, digits and blanks at least, not the file's name."""
    s = F.trim(found)
    plain = F.char_length(F.regexp_replace(s, r"[^\p{L}\p{N}\s]", ""))
    bad = (s == "") | F.lower(s).startswith("bjbj") | (plain / F.char_length(s) < 0.5) | (F.lower(s) == F.lower(stem))
    return F.when(~bad, s)


def extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext == "yml", "yaml").otherwise(ext)


def language(name: Column) -> Column:
    """The language with stop words that a code or name stands for, else null."""
    code = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for full in ("french", "english"):
        out = F.when(F.left(code, F.lit(2)) == full[:2], full).otherwise(out)
    for full, codes in LANGUAGES.items():
        out = F.when(code.isin(*codes) | F.regexp_extract(code, r"^([^-_]+)[-_]", 1).isin(*codes), full).otherwise(out)
    return out


def first_filled(*options: Column) -> Column:
    """The first of ``options`` that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(x.cast("string")), F.lit("")) for x in options])


def sha256_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Dollars by the price table, rounded to 6; null for an unknown model."""
    out = F.lit(None).cast("double")
    for name, (a, b) in PRICES.items():
        micro = (prompt_tokens * round(100 * a) + completion_tokens * round(100 * b)) / 100  # exact, so that halves go to even
        out = F.when(model == name, F.bround(micro, 0) / 1e6).otherwise(out)
    return out


def usage(text: Column) -> Column:
    """Tokens of a text for which no model has told them: its words, one at least."""
    return F.greatest(F.lit(1).cast("long"), token_count(text))


def normalized_score(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 1) / 2))


def sigmoid(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-x))))


def mask(value: Column) -> Column:
    return F.when(F.char_length(value) <= 4, "***").otherwise(F.concat(F.left(value, F.lit(3)), F.lit("***"), F.right(value, F.lit(2))))


def json_path(doc: Column, path: str) -> Column:
    """Value at ``path`` ($, a.b, a[*].k, a[0]); a name behind a list applies to each of its items."""
    return F.get_json_object(doc, path if path.startswith("$") else f"$.{path}")


def utc_time(text: Column) -> Column:
    """ISO 8601 or RFC 1123 text as a time in UTC, null where it is neither."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    http = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.coalesce(iso, http)


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDD... as an ISO date; other text as it is."""
    digits = F.regexp_extract(text, r"^D:(\d{8})", 1)
    return F.when(digits != "", F.date_format(F.try_to_timestamp(digits, F.lit("yyyyMMdd")), "yyyy-MM-dd")).otherwise(F.nullif(F.trim(text), F.lit("")))


@F.arrow_udf(ArrayType(StringType()))
def _most_frequent(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for found, most in batches:
        done = []
        for at in range(0, len(found), 1000):
            rows = found.slice(at, 1000)
            size = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = rows.flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            row = np.repeat(np.arange(len(rows)), size)
            pairs, first, n = np.unique(row * width + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_index=True, return_counts=True)
            of = pairs // width
            order = np.lexsort((first, -n, of))  # equals stay in the order of their first places
            begin = np.searchsorted(of, np.arange(len(rows) + 1))
            rank = np.arange(len(of)) - begin[of[order]]
            keep = order[rank < most.slice(at, 1000).to_numpy(zero_copy_only=False)[of[order]]]
            ends = np.searchsorted(of[keep], np.arange(len(rows) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.dictionary.take(pa.array(pairs[keep] % width)))
            done.append(pc.if_else(rows.is_valid(), lists, pa.nulls(len(rows), lists.type)))
        yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 8) -> DataFrame:
    """(id_col, keywords): the ``most`` frequent words of four letters or more, ties by first place; no row for a text without one."""
    stops = F.array(*[F.lit(w) for w in KEYWORD_STOPS])
    found = F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[A-Za-zÀ-ÿ]{4,}"), F.lit(0)), lambda w: ~F.array_contains(stops, w))
    return docs.select(id_col, _most_frequent(found, F.lit(most)).alias("keywords")).where(F.size("keywords") > 0)


def detect_language(text: Column) -> Column:
    """fr, en, de or es by the most frequent words among the first 5,000 characters; null without any."""
    seen = words(F.left(text, F.lit(5000)))
    marks = {"en": "the of and to is that it was with for", "fr": "le la les des et est une dans que pour", "de": "der die das und ist nicht ein zu den mit", "es": "el los las que y en una por con del"}

    def among(listed: list[str]):
        return lambda w: w.isin(*listed)

    hits = [F.struct(F.size(F.filter(seen, among(m.split()))).alias("n"), F.lit(code).alias("code")) for code, m in marks.items()]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["code"])
