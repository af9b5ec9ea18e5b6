"""Where words stand: an inverted index with positions, from which highlights and phrases come without reading texts again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut

_WORDS = re.compile(r"\w+")


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: set[str] | None = None) -> DataFrame:
    """(term, id, words, starts, sizes): of each lower-case word of each document the numbers of its places among the words, their first
    characters, each as the step from the one before, and their lengths.

    Made within each row; nothing is shuffled. A null or empty text has no words; rows that repeat an id have entries of their own. Of
    ``only``, a set of terms of checked size, no other entries are made.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                codes: dict[str, int] = {}
                code, word, start, size, counts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    spans = [m.span() for m in _WORDS.finditer(text or "")]
                    terms = [text[a:b].lower() for a, b in spans]
                    held = range(len(terms)) if wanted is None else [n for n, t in enumerate(terms) if t in wanted]
                    code += [codes.setdefault(terms[n], len(codes)) for n in held]
                    word += held
                    start += [spans[n][0] for n in held]
                    size += [spans[n][1] - spans[n][0] for n in held]
                    counts.append(len(held))
                code, word, start, size = (np.array(x, np.int64) for x in (code, word, start, size))
                row = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((code, row))
                code, word, start, size, row = (x[order] for x in (code, word, start, size, row))
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
                bounds = pa.array(np.r_[first, len(row)], pa.int32())
                steps = [np.diff(x, prepend=0) for x in (word, start)]
                for step, x in zip(steps, (word, start), strict=True):
                    step[first] = x[first]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (*steps, size)]
                terms = pa.array(list(codes), pa.string()).take(pa.array(code[first]))
                yield pa.RecordBatch.from_arrays([terms, part.column(0).take(pa.array(row[first])), *lists], names=["term", "id", "words", "starts", "sizes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"term string, id {kind}, words array<int>, starts array<int>, sizes array<int>")


def _places(index: DataFrame) -> DataFrame:
    """``index`` with a row for each place: term, id, word, start, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("words", "starts", "sizes")]
            n = lists[0].value_lengths().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), n)
            first = np.cumsum(n) - n
            flat = [x.flatten().to_numpy().astype(np.int64) for x in lists]
            sums = [np.cumsum(x) for x in flat[:2]]
            begun = [s - (np.r_[0, s][first])[of] if len(of) else s for s in sums]
            others = [i for i, f in enumerate(batch.schema) if f.name not in ("words", "starts", "sizes")]
            made = [batch.column(i).take(pa.array(of)) for i in others]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(x.astype(np.int32)) for x in (*begun, flat[2]))], names=[*(batch.schema[i].name for i in others), "word", "start", "size"])

    kept = [f for f in index.schema if f.name not in ("words", "starts", "sizes")]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "word int", "start int", "size int"])
    return index.select(*[f.name for f in kept], "words", "starts", "sizes").mapInArrow(run, kinds)


def highlights(index: DataFrame, asked: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, id, start, end, term) for ``asked`` (by, id, terms): the words of each document that begin with one of the terms, in
    characters of its text. A place comes once, with the first such term of the list; blank terms and documents beyond the index have none.

    Only documents that are asked for are joined, by id; a term is compared with the different words of a document, not with its text.
    """
    terms = F.filter(F.transform("terms", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    rows = index.join(asked.select(by, "id", terms.alias("_terms")), "id")
    rows = rows.withColumn("_hit", F.get(F.filter("_terms", lambda t: F.col("term").startswith(t)), F.lit(0))).where(F.col("_hit").isNotNull()).drop("_terms", "term")
    return _places(rows).select(by, "id", "start", (F.col("start") + F.col("size")).alias("end"), F.col("_hit").alias("term"))


def phrases(index: DataFrame, asked: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, id, word, start, end) of every place where the words of ``asked`` (by, words array<string>) stand one after the other, any letter case.

    The index is joined on the words asked for alone. A phrase begins at the places of its rarest word; its other words are looked up only
    in the documents of that one, and places meet by document and by where the phrase would begin, so that what is joined
    grows with the rarest words and not with the frequent ones. An empty phrase is nowhere.
    """
    each = asked.select(by, F.posexplode(F.transform("words", lambda w: F.lower(w))).alias("_i", "term"), F.size("words").alias("_n"))
    held = cut(index.join(each.select("term").distinct(), "term", "left_semi"))
    often = cut(held.groupBy("term").agg(F.sum(F.size("words")).alias("_places")))
    each = cut(each.join(often, "term"))
    rarest = each.groupBy(by).agg(F.min_by("_i", F.struct("_places", "_i")).alias("_rarest"))
    each = each.join(rarest, by)
    begun = _begins(held.join(each.where("_i = _rarest").select(by, "_i", "_n", "term"), "term"), by, "_n")
    begun = cut(begun.where("_first >= 0"))
    others = each.where("_i <> _rarest").select(by, "_i", F.col("term").alias("_term"))
    sought = begun.select(by, F.col("id").alias("_id")).distinct().join(others, by)
    looked = held.join(sought, (F.col("term") == F.col("_term")) & F.col("id").eqNullSafe(F.col("_id"))).drop("_term", "_id")
    starts = begun.select(F.col(by).alias("_by"), F.col("id").alias("_id"), F.col("_first").alias("_at"), "_n").distinct()
    same = (F.col(by) == F.col("_by")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("_first") == F.col("_at"))
    met = _begins(looked, by).join(starts, same).drop("_by", "_id", "_at").unionByName(begun)
    met = met.groupBy(by, "id", "_first", "_n").agg(F.count_distinct("_i").alias("_met"), F.min("start").alias("start"), F.max("end").alias("end"))
    return met.where(F.col("_met") == F.col("_n")).select(by, "id", F.col("_first").alias("word"), "start", "end")


def _begins(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each place of ``rows`` with the place where the phrase would begin: ``more``, id, _i, _first, start, end."""
    first, end = F.col("word") - F.col("_i"), F.col("start") + F.col("size")
    return _places(rows).select(*more, "id", "_i", first.alias("_first"), "start", end.alias("end"))
