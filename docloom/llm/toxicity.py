"""Toxicity by the votes of the nearest labelled examples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held_out, read, texts

#: Most labelled examples of each class in the index; their texts bound the model.
SAMPLE = 1_500
#: Examples from which on a term is one, and the chi-square that chance alone exceeds for a twentieth of terms.
MIN_EXAMPLES, CHANCE = 4, 3.84
#: Nearest examples that vote, examples of a block, blocks that a search opens first, examples and terms that are shown as evidence.
NEIGHBOURS, BLOCK, FIRST, EVIDENCE, SHOWN = 10, 64, 4, 3, 8
#: Least over greatest bound of a block from which on all are read at once.
ALIKE = 0.3
#: Distinct words whose terms a worker remembers; the memory starts anew when it is full.
REMEMBERED = 300_000
#: Bytes of the beginnings of words that are terms; a beginning has more terms from each of these counts and parts of all words on.
STEMS, OFTEN, DENSE = (4, 5, 6, 7), (3, 8), (0.004, 0.016)
THRESHOLD = 0.7

_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a whole text: ASCII lower case, cut at ASCII characters that are no letter or digit."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def count_terms(text: str, known: dict[bytes, int] | None = None) -> Counter[bytes]:
    """How often each term stands in a text: words, beginnings of longer words (marked by *), and for
    beginnings that come often or densely a term for each step that they reach. Only ``known`` ones, if given."""
    counts = Counter(words(text))
    total = sum(counts.values())
    stems: Counter[bytes] = Counter()
    for w, n in counts.items():
        for k in STEMS:
            if len(w) <= k:
                break
            if known is None or w[:k] + b"*" in known:
                stems[w[:k] + b"*"] += n
    if known is not None:
        counts = Counter({w: n for w, n in counts.items() if w in known})
    for w, n in stems.items():
        counts[w] = n
        for kind, steps, reached in ((b"n", OFTEN, n), (b"d", DENSE, n / total)):
            for k, least in enumerate(steps):
                if reached >= least:
                    counts[w + kind + b"%d" % k] = 1
    return counts if known is None else Counter({w: n for w, n in counts.items() if w in known})


Vector = tuple[np.ndarray, np.ndarray]


class BlockMaxIndex:
    """Inverted index of the examples' unit TF-IDF vectors with the greatest weight of each term in each block.

    A block is BLOCK examples next to each other. A query bounds every block by its terms' greatest weights and scores the
    FIRST blocks of the highest bounds; then all others whose bound reaches the last of its nearest so far. No other
    block can hold a nearer example, so what it returns is exact. Where the bounds themselves are alike all blocks are scored at once.
    """

    def __init__(self, vectors: list[Vector], n_terms: int):
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        # where the postings of a term in a block begin
        self.start = np.searchsorted(term * self.blocks + self.example // BLOCK, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        self.best = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.best, (term, self.example // BLOCK), self.weight)

    def _scored(self, ts: np.ndarray, ws: np.ndarray, blocks: np.ndarray | None) -> Vector:
        """The examples of ``blocks`` (None: all) that share a term with the query, and their cosines."""
        if blocks is None:
            a, b = self.start[ts * self.blocks], self.start[(ts + 1) * self.blocks]
        else:
            cell = (ts[:, None] * self.blocks + blocks).ravel()
            a, b, ws = self.start[cell], self.start[cell + 1], np.repeat(ws, len(blocks))
        n = b - a
        at = np.repeat(a - np.cumsum(n, dtype=np.int32) + n, n)
        at += np.arange(len(at), dtype=np.int32)
        weight = np.repeat(ws, n)
        weight *= self.weight[at]
        scores = np.bincount(self.example[at], weight, self.size)
        hits = np.flatnonzero(scores > 0)
        return hits, scores[hits]

    def nearest(self, query: Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest positive cosine and those cosines; ties to the earlier example."""
        ts, ws = query
        if not len(ts) or not self.size:
            return []
        bounds = ws @ self.best[ts]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        if not len(order):
            return []
        if bounds[order[-1]] > ALIKE * bounds[order[0]]:
            at, scores = self._scored(ts, ws, None)  # bounds so alike that hardly a block would be left out
        else:
            at, scores = self._scored(ts, ws, np.sort(order[:FIRST]))
            found = scores[at != without]
            last = np.partition(found, -k)[-k] - 1e-12 if len(found) >= k else 0.0
            rest = order[FIRST:][bounds[order[FIRST:]] >= last]
            if len(rest):
                more, found = self._scored(ts, ws, np.sort(rest) if 4 * len(rest) < self.blocks else None)
                new = ~np.isin(more // BLOCK, order[:FIRST])
                at, scores = np.concatenate([at, more[new]]), np.concatenate([scores, found[new]])
        stay = at != without
        at, scores = at[stay], scores[stay]
        if len(at) > k:
            near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            at, scores = at[near], scores[near]
        best = np.lexsort((at, -scores))[:k]
        return list(zip(scores[best].tolist(), at[best].tolist(), strict=True))


class Model:
    """Examples, their index and the calibration of the votes."""

    def __init__(self, examples: list[tuple[object, int, dict[int, int]]], chosen: list[tuple[bytes, int, float]], prior: float):
        """``examples``: id, label and counts of numbered terms; ``chosen``: terms, their examples and weights; ``prior``: part of label 1 among all labels."""
        self.ids, self.labels = [e[0] for e in examples], np.array([e[1] for e in examples], np.int64)
        self.number = {t: i for i, (t, _, _) in enumerate(chosen)}
        # beginnings that are terms or have steps that are, their numbers (-1) and those of their steps
        self.stems = {t: i for i, t in enumerate(sorted(t for t in known_terms(self.number) if t.endswith(b"*")))}
        steps = [(d, least, kind + b"%d" % k) for d, kind, levels in ((False, b"n", OFTEN), (True, b"d", DENSE)) for k, least in enumerate(levels)]
        self.parts = [(self.number.get(t, -1), tuple((d, least, self.number[t + name]) for d, least, name in steps if t + name in self.number)) for t in self.stems]
        self.words: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.idf = (np.log((len(examples) + 1) / (np.array([d for _, d, _ in chosen], float) + 1)) + 1) * np.array([w for _, _, w in chosen])
        vectors = [self.vector(counts) for _, _, counts in examples]
        # examples with the same strongest term are neighbours, so that blocks differ in their greatest weights
        strongest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (strongest[i], examples[i][1], i))
        vectors, self.ids, self.labels = [vectors[i] for i in order], [self.ids[i] for i in order], self.labels[order]
        self.index = BlockMaxIndex(vectors, len(self.number))
        self._calibrate(vectors, prior)

    def vector(self, counts: dict[int, int]) -> Vector:
        """Unit TF-IDF vector of the counts of numbered terms: their numbers and weights."""
        at = np.array(list(counts), np.int64)
        v = (1 + np.log(np.array(list(counts.values()), float))) * self.idf[at]
        return at, v / max(np.sqrt((v * v).sum()), 1e-300)

    def _terms_of(self, word: bytes) -> tuple[int, tuple[int, ...]]:
        """The number of a word, -1 if it is no term, and its beginnings that are of use."""
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        stems = tuple(s for s in (self.stems.get(word[:k] + b"*") for k in STEMS if len(word) > k) if s is not None)
        found = self.words[word] = (self.number.get(word, -1), stems)
        return found

    def count(self, text: str) -> dict[int, int]:
        """How often each numbered term stands in a text: count_terms, of these terms alone."""
        listed = words(text)
        get, out, stems = self.words.get, {}, {}
        for w, n in Counter(listed).items():
            own, starts = get(w) or self._terms_of(w)
            if own >= 0:
                out[own] = n
            for s in starts:
                stems[s] = stems.get(s, 0) + n
        for s, n in stems.items():
            own, steps = self.parts[s]
            if own >= 0:
                out[own] = n
            for dense, least, number in steps:
                if (n / len(listed) if dense else n) >= least:
                    out[number] = 1
        return out

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Part of label 1 among the nearest, each weighted by its closeness."""
        weights = np.array([s / (1.05 - s) for s, _ in near])
        return float(weights @ self.labels[[i for _, i in near]] / weights.sum())

    def _calibrate(self, vectors: list[dict[int, float]], prior: float) -> None:
        """Fits the probability of label 1 to votes that leave the example itself out, at the share ``prior``."""
        ones, zeros = int(self.labels.sum()), int((1 - self.labels).sum())
        weight = np.where(self.labels == 1, prior / max(ones, 1), (1 - prior) / max(zeros, 1)) * len(vectors)
        votes, ys, ws, none = [], [], [], np.array([prior, 1 - prior])
        for i, v in enumerate(vectors):
            near = self.index.nearest(v, NEIGHBOURS, i)
            if near:
                votes.append(self.vote(near))
                ys.append(self.labels[i])
                ws.append(weight[i])
            else:
                none[1 - self.labels[i]] += weight[i]
        self.alone = float(none[0] / none.sum())
        x, y, w = np.array(votes), np.array(ys, float), np.array(ws)
        total = max(w.sum(), 1.0)
        goal = np.where(y == 1, (total + 1) / (total + 2), 1 / (total + 2))
        a, b = 4.0, -2.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(w * (goal - p) * x).sum() - 0.01 * a, (w * (goal - p)).sum() - 0.01 * b])
            r = w * p * (1 - p)
            h = np.array([[(r * x * x).sum() + 0.01, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = float(np.clip(a + np.clip(step[0], -4, 4), 0.5, 60)), float(np.clip(b + np.clip(step[1], -4, 4), -60, 60))
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = a, b

    def score(self, text: str) -> tuple[float, list[tuple[float, int]], list[int]]:
        """The probability of label 1, the nearest examples and the numbers of the SHOWN terms that weigh most in the text."""
        counts = self.count(text)
        at, weight = vector = self.vector(counts)
        near = self.index.nearest(vector, NEIGHBOURS)
        if not near:
            return self.alone, [], []
        return float(1 / (1 + np.exp(-(self.slope * self.vote(near) + self.shift)))), near, at[np.argsort(-weight, kind="stable")[:SHOWN]].tolist()


def known_terms(number: dict[bytes, int]) -> dict[bytes, int]:
    """The numbered terms with the beginnings (-1) whose steps are among them."""
    return number | {t.partition(b"*")[0] + b"*": -1 for t in number if b"*" in t and t.partition(b"*")[0] + b"*" not in number}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of ``sample`` labelled documents of each class at most, chosen by a hash of the id.

    Terms are all words and beginnings of words in MIN_EXAMPLES examples or more. A term weighs its inverse document frequency times its
    supervised weight, what the chi-square of term and label has above CHANCE over the number of examples: it falls to nothing for a term
    that says nothing of the label, and no number of terms leaves one out. Counts over
    the examples are gathered by Spark. Without both classes, or without labels, there are no terms and every score is the prior.
    """
    own = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    every = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    picked = [own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "id"))
    n, n1 = chosen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter[bytes]] = {0: Counter(), 1: Counter()}
            for text, label in zip(texts(batch), batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
                counts[label].update(count_terms(text).keys())
            for label, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])

    d, a = F.col("d"), F.col("a")
    df = chosen.mapInArrow(seen, "term binary, label int, n long").groupBy("term").agg(F.sum("n").cast("double").alias("d"), F.sum(F.col("n") * F.col("label")).cast("double").alias("a"))
    df = df.where((d >= MIN_EXAMPLES) & (d < n)) if 0 < n1 < n else df.where("false")
    df = df.withColumn("chi", n * F.pow(a * (n - n1) - (d - a) * n1, 2) / (float(n1) * (n - n1) * d * (n - d)))
    df = df.withColumn("weight", (F.col("chi") - CHANCE) / n).where("weight > 0")
    best = sorted((bytes(r["term"]), int(r["d"]), float(r["weight"])) for r in df.collect())
    number = {t: i for i, (t, _, _) in enumerate(best)}
    known = known_terms(number)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{number[t]: c for t, c in count_terms(text, known).items() if t in number} for text in texts(batch)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("id", "label")] + [pa.array([list(f) for f in found], kind), pa.array([list(f.values()) for f in found], kind)], names=["id", "label", "terms", "counts"])

    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([chosen.schema["id"], chosen.schema["label"], T.StructField("terms", kind), T.StructField("counts", kind)])
    rows = sorted((r.id, r.label, r.terms, r.counts) for r in chosen.mapInArrow(counted, schema).collect())
    prior = (every.get(1, 0) + 1) / (sum(every.values()) + 2)
    return Model([(i, y, dict(zip(t, c, strict=True))) for i, y, t, c in rows], best, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence, terms) for each row: its whole text against the labelled examples.

    ``evidence`` has the EVIDENCE nearest examples (id, cosine, label), ``terms`` what the text shares with the index.
    A null or empty text, or one without any of the terms, has no neighbours and scores as such examples do.
    Rows are independent. The model is bounded by its parameters and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("score", T.DoubleType()),
            T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))),
            T.StructField("terms", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [t.decode("utf-8", "replace") for t in m.number]
        for batch in batches:
            id_type = batch.schema.field(0).type
            evidence = pa.list_(pa.struct([("id", id_type), ("cosine", pa.float64()), ("label", pa.int32())]))
            found = [m.score(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([[{"id": m.ids[i], "cosine": s, "label": int(m.labels[i])} for s, i in f[1][:EVIDENCE]] for f in found], evidence),
                    pa.array([[names[i] for i in f[2]] for f in found], pa.list_(pa.string())),
                ],
                names=["id", "score", "evidence", "terms"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    away = held_out(F.col("doc_id"), 3, 1)
    out = score(docs, fit(docs, labels.where(~away)))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "terms")
