"""Language identification by character n-gram profiles learned from texts of known languages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram (three code points fit a long), grams of a language that a profile keeps at most, grams that a worker sorts at once.
GRAM, MOST_GRAMS, HELD = 3, 50_000, 4_000_000
#: What is added to every count.
PRIOR = 0.5


def letters(text: Column) -> Column:
    """Lower-case words of letters between single blanks, one at either end; a blank for a text without letters or none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}]+", " ")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram as a number, row) of all grams of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    gram = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    whole = row[2:] == row[:-2]
    return gram[whole], row[:-2][whole]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of some HELD characters."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        held.append(text)
        size += len(text)
        if size >= HELD:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """(lang, gram long, n, total): how often a language's ``most`` frequent grams come in its texts, and all of its grams.

    Tasks count what they read before anything is shuffled. Rows without a language teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, texts in _parts(batch, 1):
                of = langs[first : first + len(texts)]
                for lang in sorted(set(of.tolist())):
                    gram, n = np.unique(_grams([t for t, x in zip(texts, of, strict=True) if x == lang])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), letters(F.col(text_col)).alias("text"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("lang")
    ranked = counts.withColumn("place", F.row_number().over(whole.orderBy(F.desc("n"), "gram"))).where(F.col("place") <= most).drop("place")
    return ranked.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang")


class Identifier:
    """Log-probabilities of grams by language; what a profile does not have counts PRIOR."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        """``rows``: (lang, gram, n, total) of all profiles."""
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        total = {r[0]: r[3] for r in rows}
        counts = np.zeros((len(self.grams), len(self.langs)))
        place = {x: i for i, x in enumerate(self.langs)}
        if rows:
            counts[np.searchsorted(self.grams, [r[1] for r in rows]), [place[r[0]] for r in rows]] = [r[2] for r in rows]
        size = np.array([total[x] + PRIOR * len(self.grams) for x in self.langs])
        self.logs = np.log(np.vstack([counts, np.zeros((1, len(self.langs)))]) + PRIOR) - np.log(size)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood by row and language, grams of each row)."""
        gram, row = _grams(texts)
        at = np.searchsorted(self.grams, gram)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == gram), at, len(self.grams)) if len(self.grams) else at
        out = np.stack([np.bincount(row, self.logs[at, j], len(texts)) for j in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return out, np.bincount(row, minlength=len(texts))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_GRAMS) -> Identifier:
    """An identifier of the languages of ``docs``; the driver gets ``most`` grams a language."""
    return Identifier([tuple(r) for r in profiles(docs, text_col, lang_col, most).select("lang", "gram", "n", "total").collect()])


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, language, margin) of each row's whole text.

    ``language`` is the one under which the text's grams are likeliest, of equals the first by code; null for a text without a
    letter, and where nothing was learned. ``margin`` is how much likelier a gram is on average than under the next language, in log10: near 0 for
    texts of several languages in like parts, of which the larger part decides; null where there is no next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            language, margin = [], []
            for _, texts in _parts(batch, 1):
                scores, n = known.scores(texts)
                for s, k in zip(scores, n.tolist(), strict=True):
                    order = np.argsort(-s, kind="stable") if k else []
                    language.append(known.langs[order[0]] if len(order) else None)
                    margin.append(float(s[order[0]] - s[order[1]]) / k / math.log(10) if len(order) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(margin, pa.float64())], names=[id_col, "language", "margin"])

    return docs.select(F.col(id_col), letters(F.col(text_col)).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, language string, margin double")
