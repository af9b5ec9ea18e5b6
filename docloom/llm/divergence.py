"""Source divergence audit: how the words of a source differ from those of the other sources of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import buffers, group, slices
from .common import cut, read

#: Probabilities are whole parts of this many.
UNIT = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: Counts that a task holds before it passes them on, and that a block of terms has at least.
HELD, BLOCK = 1 << 20, 1 << 14
#: Languages up to which their sizes are broadcast.
LANGUAGES = 10_000
#: Bytes of a term: letters, and all bytes of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
FOUND = "lang string, source string, part string, item string, value long"


class Counts:
    """Occurrences and documents of (group, term), held in numbers; ``flush`` gives them as a batch and starts anew."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {b"": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, groups: np.ndarray, codes: np.ndarray, rows: np.ndarray, found: list[bytes]) -> None:
        """``groups``: of each row; the empty term stands for a group itself, with its rows as documents."""
        known = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in found), np.int64, len(found))
        pairs, n = np.unique(codes * len(groups) + rows, return_counts=True)
        term, of = known[pairs // len(groups)] if len(pairs) else pairs, groups[pairs % len(groups)]
        self._keep(np.stack([np.concatenate([term, np.zeros(len(groups), np.int64)]), np.concatenate([of, groups]), np.concatenate([n, np.zeros(len(groups), np.int64)]), np.ones(len(pairs) + len(groups), np.int64)]))

    def _keep(self, made: np.ndarray) -> None:
        self.parts.append(self._sum(made))
        self.size += self.parts[-1].shape[1]
        if len(self.parts) > 8:
            self.parts = [self._sum(np.concatenate(self.parts, axis=1))]
            self.size = self.parts[0].shape[1]

    def _sum(self, made: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(made[0] * max(1, len(self.groups)) + made[1], return_inverse=True)
        out = np.zeros((4, len(keys)), np.int64)
        out[0], out[1] = keys // max(1, len(self.groups)), keys % max(1, len(self.groups))
        np.add.at(out[2], inverse, made[2])
        np.add.at(out[3], inverse, made[3])
        return out

    def flush(self) -> pa.RecordBatch:
        term, of, n, docs = self._sum(np.concatenate([*self.parts, np.zeros((4, 0), np.int64)], axis=1))
        names = list(self.groups)
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(of)) for i in (0, 1))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string()).take(pa.array(term))
        self.__init__()
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n), pa.array(docs)], schema=COUNTED)


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and documents, the term '' once for each row of a group.

    A term is a run of letters or of characters beyond ASCII, A-Z lower-cased. It is found by looking every byte of a batch's text
    buffer up in a table, and its slices are grouped by XXH64 and compared byte by byte. Nulls are empty; every row is a
    document, whatever its id; a text must fit a task.
    """
    kinds = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for first, buf, offsets in buffers(batch.column(2)):
                of = np.fromiter((counts.groups.setdefault(k, len(counts.groups)) for k in keys[first : first + len(offsets) - 1]), np.int64, len(offsets) - 1)
                starts, ends, rows = slices(buf, offsets, TERM)
                codes, found = group(buf, starts, ends)
                counts.add(of, codes, rows, found)
                if counts.size >= HELD:
                    yield counts.flush()
        yield counts.flush()

    return docs.select(*kinds).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) for 0 < count + 1 <= total, by long division in steps of a thousand: exact
    for totals up to 9e15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def compare_block(terms: list[str], rows: np.ndarray, cols: np.ndarray, n: np.ndarray, totals: np.ndarray, whole: int, top: int = TOP) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
    """(sums, terms above): of one block of a language's terms, the sum of distances of each source (row) to each other (column),
    and each source's ``top`` terms that it has more often than the language.

    ``rows`` (sources), ``cols`` (terms) and ``n`` are the counts above zero; ``totals``: N + V of each source, ``whole``: of the
    language. A source is a row of a sparse matrix: where both have nothing, the distance is the same for all terms.
    """
    order = np.lexsort((cols, rows))
    rows, cols, n = rows[order], cols[order], n[order]
    size, sources = len(terms), len(totals)
    indptr = np.searchsorted(rows, np.arange(sources + 1))
    some = np.flatnonzero(np.diff(indptr))  # reduceat needs rows that are not empty
    own = shares(n, totals[rows])
    nothing = shares(np.zeros(sources, np.int64), totals)
    sums = np.zeros((sources, sources), np.int64)

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(sources, np.int64)
        if len(some):
            out[some] = np.add.reduceat(x, indptr[some])
        return out

    for h in range(sources):
        theirs = slice(indptr[h], indptr[h + 1])
        q = np.full(size, nothing[h])
        q[cols[theirs]] = own[theirs]
        has = np.zeros(size, bool)
        has[cols[theirs]] = True
        both = has[cols]
        only = np.zeros(sources, np.int64)  # terms of h alone, at each source's share of nothing
        for g in range(0, sources, 64):
            only[g : g + 64] = distances(nothing[g : g + 64, None], own[None, theirs]).sum(1)
        at = distances(nothing[rows], q[cols])
        only -= by_row(np.where(both, at, 0))
        neither = size - np.diff(indptr) - (indptr[h + 1] - indptr[h]) + by_row(both.astype(np.int64))
        sums[:, h] = by_row(distances(own, q[cols])) + only + neither * distances(nothing, nothing[h])
    everywhere = np.zeros(size, np.int64)
    np.add.at(everywhere, cols, n)
    q = shares(everywhere, np.full(size, whole))[cols] if size else own
    f = np.where(own > q, distances(own, q), -1)
    above = []
    for g in range(sources):
        mine = np.arange(indptr[g], indptr[g + 1])
        mine = mine[f[mine] >= 0]
        if len(mine) > top:  # all that reach the value of the last, for ties go by name
            least = np.partition(f[mine], len(mine) - top)[len(mine) - top]
            mine = mine[f[mine] >= least]
        best = sorted(((-int(f[i]), terms[cols[i]]) for i in mine), key=lambda x: (x[0], x[1].encode()))[:top]
        above += [(g, t, -v) for v, t in best]
    return sums, above


def _compare(key: tuple[pa.Scalar, ...], counts: pa.Table, groups: pa.Table) -> pa.Table:
    lang, names = key[0].as_py(), groups["of"].to_pylist()
    places = {s: i for i, s in enumerate(names)}
    words = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    rows = np.fromiter((places[s] for s in counts["source"].to_pylist()), np.int64, counts.num_rows)
    n = groups["total"].to_numpy().astype(np.int64)
    v = int(groups["terms"][0].as_py())
    terms = words.dictionary.to_pylist()
    totals = np.maximum(n + v, 1)  # without terms nothing is divided
    sums, above = compare_block(terms, rows, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts["n"].to_numpy().astype(np.int64), totals, max(1, int(groups["whole"][0].as_py()) + v))
    g, h = np.nonzero(~np.eye(len(names), dtype=bool))
    named = pa.array(names, pa.string())
    size = len(g) + len(above)
    return pa.table(
        {
            "lang": pa.array([lang] * size, pa.string()),
            "source": pa.concat_arrays([named.take(pa.array(g)), pa.array([names[x[0]] for x in above], pa.string())]),
            "part": pa.array(["pair"] * len(g) + ["term"] * len(above), pa.string()),
            "item": pa.concat_arrays([named.take(pa.array(h)), pa.array([x[1] for x in above], pa.string())]),
            "value": pa.concat_arrays([pa.array(sums[g, h]), pa.array([x[2] for x in above], pa.int64())]),
        }
    )


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ from other sources (part ``pair``, item the
    other source) and which words it has more often than its language (part ``term``, the first 200).

    A language keeps the terms of ``min_docs`` of its documents or more. Of N kept occurrences and V kept terms, a term of ``count`` has the
    share p = 1 + floor(UNIT * (count + 1) / (N + V)); a distance is floor((p - q)^2 / q). All arithmetic is of whole numbers.

    One pass counts terms within tasks; the sums are dealt by language and term, which settles both a source's counts and what is
    kept in one shuffle, so that neither a hot source nor a hot word meets in a task before it is summed. Terms are then
    compared in blocks of a language; a block holds so many counts that its pairs of sources are no more than those. Nulls are empty
    strings and every row is a document; a source without kept terms still has its pairs; a language of one source has none; no rows give
    none. Other columns, whatever their names, are not looked at.
    """
    w = Window.partitionBy("lang", "term")
    summed = count_terms(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = summed.withColumn("in_docs", F.sum("docs").over(w)).withColumn("once", F.row_number().over(w.orderBy("source")) == 1)
    is_term = F.col("term") != ""
    kept = cut(summed.where(~is_term | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", (is_term & F.col("once")).cast("long").alias("one")))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("one").alias("ones"), F.count("*").alias("size"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("whole"), F.sum("ones").alias("terms"), (F.sum("size") - F.count("*")).alias("size"), F.count("*").alias("sources"))
    langs = cut(langs.withColumn("blocks", F.ceil(F.col("size") / F.greatest(F.lit(BLOCK), F.col("sources") * F.col("sources")))).withColumn("blocks", F.greatest("blocks", F.lit(1))))
    beside = F.broadcast(langs) if langs.limit(LANGUAGES + 1).count() <= LANGUAGES else langs
    counts = kept.where(is_term).join(beside.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    each = groups.join(beside, "lang").select(F.col("lang").alias("in_lang"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("in_block"), F.col("source").alias("of"), groups["n"].alias("total"), "terms", "whole")
    found = counts.groupBy("lang", "block").cogroup(each.groupBy("in_lang", "in_block")).applyInArrow(_compare, FOUND)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


_P = f"1 + ({UNIT} * (c + 1)) // (n + v)"
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), words AS (SELECT d, lang, source, unnest(ws) AS term FROM docs
), terms AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}
), sized AS (SELECT lang, count(*) AS v, sum(c) AS n FROM terms GROUP BY ALL
), whole AS (SELECT lang, term, ({_P.replace("c + 1", "c::HUGEINT + 1")})::HUGEINT AS q FROM terms JOIN sized USING (lang)
), counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN terms USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), totals AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), each AS (
  SELECT t.lang, t.source, term, coalesce(k.c, 0) AS c, ({_P.replace("c + 1", "coalesce(k.c, 0)::HUGEINT + 1").replace("(n + v)", "(t.n + s.v)")})::HUGEINT AS p
  FROM totals t JOIN terms USING (lang) JOIN sized s USING (lang) LEFT JOIN counts k USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM each a JOIN each b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM each JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= {TOP}
"""
