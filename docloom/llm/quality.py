"""Quality rules: a conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, read

#: Most labelled documents of each class that the field is fitted on, and the lines of one training sequence.
SAMPLE, PIECE = 500, 32
#: Penalties on the weights and on the moves between states, and how often line states are found anew.
DECAY, MOVE_DECAY, TURNS = 1e-3, 1e-2, 4
#: Least share of a kept document's words that stand in lines of content.
SHARE = 0.5
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "upper", "symbols", "digits", "shouts", "bars", "same_words", "repeats", "copy", "closed", "short", "length", "word_length", "no_lower", "empty", "runs", "letters")

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_MIX = np.random.default_rng(20).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated(words: list[bytes]) -> np.ndarray:
    """For each word, whether it stands in a window of WINDOW words that the text has twice or more."""
    n = len(words)
    inside = np.zeros(n, bool)
    if n <= WINDOW:
        return inside
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == n:
        return inside
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0xBF58476D1CE4E5B9)
    ids ^= ids >> np.uint64(32)
    windows = n - WINDOW + 1
    code = np.zeros(windows, np.uint64)
    for k in range(WINDOW):
        code = (code ^ ids[k : k + windows]) * _MIX[k]
        code ^= code >> np.uint64(31)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(windows, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return np.cumsum(marks[:n]) > 0


def describe(text: str) -> tuple[list[tuple[float, ...]], list[int], tuple[int, int, int, int, int]]:
    """The features of each line, its words, and of the whole text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    split = [line.split() for line in lines]
    words = [w for s in split for w in s]
    inside = repeated(words)
    heads = np.concatenate([[0], np.cumsum(inside)])
    out, seen, dups, at = [], set(), 0, 0
    for line, own in zip(lines, split, strict=True):
        n = len(own)
        if not n:
            out.append((1.0, *[0.0] * 13, 1.0, 0.0, 0.0))
            continue
        copy = line in seen
        seen.add(line)
        dups += copy
        size = len(line) - n + 1
        upper = len(line) - len(line.translate(None, _UPPER))
        lower = len(line) - len(line.translate(None, _LOWER))
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        digits = len(line) - len(line.translate(None, _DIGITS))
        again = sum(map(bytes.__eq__, own, own[1:])) if n > 1 else 0
        out.append(
            (
                1.0,
                upper / max(upper + lower, 1),
                min(symbols / n, 1.0),
                digits / max(size, 1),
                min(line.count(b"!") / n, 1.0),
                min(line.count(b"|") / n, 1.0),
                1.0 - len(set(own)) / n,
                float(heads[at + n] - heads[at]) / n,
                float(copy),
                float(own[-1][-1:] in b".!?:;"),
                float(n < 5),
                min(n, 100) / 100,
                min(size / n, 20.0) / 20,
                float(not lower),
                0.0,
                again / n,
                min((upper + lower) / max(size, 1), 1.0),
            )
        )
        at += n
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return out, [len(s) for s in split], (len(words), chars, symbols, dups, int(inside.sum()))


def likelihood(theta: np.ndarray, X: np.ndarray, live: np.ndarray, gold: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalised log likelihood of the states ``gold`` (one-hot) of padded sequences ``X``, each counting by ``share``, and its gradient.

    ``theta`` holds the weights of features by state and the moves between states.
    """
    size = X.shape[2] * 2
    W, A = theta[:size].reshape(-1, 2), theta[size:].reshape(2, 2)
    penalty = np.r_[np.full(size, DECAY), np.full(4, MOVE_DECAY)]
    pairs = live[:, 1:] & live[:, :-1]
    e = X @ W
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    long = X.shape[1]
    for k in range(1, long):
        step = np.logaddexp(a[:, k - 1, 0, None] + A[0], a[:, k - 1, 1, None] + A[1]) + e[:, k]
        a[:, k] = np.where(live[:, k, None], step, a[:, k - 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    for k in range(long - 2, -1, -1):
        ahead = b[:, k + 1] + e[:, k + 1]
        step = np.logaddexp(A[:, 0] + ahead[:, 0, None], A[:, 1] + ahead[:, 1, None])
        b[:, k] = np.where(live[:, k + 1, None], step, 0.0)
    p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
    q = np.exp(a[:, :-1, :, None] + A + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
    moved = gold[:, :-1, :, None] * gold[:, 1:, None, :] * pairs[:, :, None, None]
    value = float(share @ ((gold * e).sum((1, 2)) + (moved * A).sum((1, 2, 3)) - z) - 0.5 * (penalty * theta * theta).sum())
    gw = np.einsum("i,ikf,iks->fs", share, X, gold - p)
    ga = np.einsum("i,ikst->st", share, moved - q)
    return value, np.r_[gw.ravel(), ga.ravel()] - penalty * theta


class Field:
    """A linear-chain conditional random field over lines with the states 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray, int]], turns: int = TURNS) -> Field:
        """The field of ``documents`` (features and words of each line, label of the whole), whose lines have no labels.

        Line states are latent. They begin as what an independent model of single lines says, and are then found again ``turns``
        times by Viterbi decoding under the field so far, held to what a label says of its document: of a good one at least
        half of the words stand in content, of a bad one at most half. So a good line in a bad document, or a bad one in a good document,
        keeps its own state, and transitions are learned from the switches that are there.
        """
        field = cls(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
        documents = [d for d in documents if d[1].sum()]
        if len({y for _, _, y in documents}) < 2:
            field.weights[0, 1] = 1.0
            return field
        field = field._climb([(x, np.full(len(x), y), y) for x, _, y in documents], 120, chain=False)
        for turn in range(turns):
            states = [field._held(x, n, y) for x, n, y in documents]
            field = field._climb([(x, s, y) for (x, _, y), s in zip(documents, states, strict=True)], 60)
        return field

    def _held(self, x: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
        """The most probable states of a document's lines, with as few lines as it takes, the least certain first, turned to its label."""
        states = np.array(self.decode(x))
        e = x @ self.weights
        order = np.argsort(-(e[:, 1] - e[:, 0]) * (1 if label else -1), kind="stable")
        for k in order[states[order] != label]:
            if 2 * words[states == label].sum() >= words.sum():
                break
            states[k] = label
        return states

    def _climb(self, sequences: list[tuple[np.ndarray, np.ndarray, int]], rounds: int, chain: bool = True, rate: float = 0.1) -> Field:
        """The field after ``rounds`` steps of Adam up the penalised likelihood of ``sequences`` (features, states, label), from this one on."""
        pieces = [(x[k : k + PIECE], s[k : k + PIECE], y) for x, s, y in sequences for k in range(0, len(x), PIECE)]
        long = max(len(x) for x, _, _ in pieces)
        X, gold = np.zeros((len(pieces), long, len(FEATURES))), np.zeros((len(pieces), long, 2))
        live = np.zeros((len(pieces), long), bool)
        for i, (x, s, _) in enumerate(pieces):
            X[i, : len(x)], live[i, : len(x)] = x, True
            gold[i, np.arange(len(x)), s] = 1
        # each class and each document count alike, however many lines they have
        y = np.array([y for _, _, y in pieces])
        share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) / live.sum(1)
        theta = np.r_[self.weights.ravel(), self.moves.ravel()]
        m = v = np.zeros_like(theta)
        for t in range(1, rounds + 1):
            _, g = likelihood(theta, X, live, gold, share)
            if not chain:
                g[self.weights.size :] = 0
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return Field(theta[: self.weights.size].reshape(self.weights.shape), theta[self.weights.size :].reshape(2, 2))

    def decode(self, features: list[tuple[float, ...]]) -> list[int]:
        """The most probable states of a document's lines, by Viterbi; equal paths go to content."""
        e = np.asarray(features) @ self.weights
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        rows = iter(e.tolist())
        b, c = next(rows)
        for x, y in rows:
            b0, c0, b1, c1 = b + stay0, c + to0, b + to1, c + stay1
            back.append((int(c0 >= b0), int(c1 >= b1)))
            b, c = max(b0, c0) + x, max(b1, c1) + y
        state = int(c >= b)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """The field fitted on ``sample`` labelled documents of each class at most, chosen by a hash of the id.

    No table has labels of lines; their states are latent and held to the labels of documents (see Field.fit).
    The sample bounds what the driver gets: features of lines, never texts. Labels that are
    null or not of both classes give a field that keeps every line.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = [own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, label in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "text", "label")), strict=True):
                features, words, _ = describe(text or "")
                flat = np.c_[np.asarray(features, np.float32), np.array(words, np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([label], pa.int32()), pa.array([flat.tobytes()])], names=["id", "label", "x"])

    schema = T.StructType([chosen.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    rows = sorted(((r.id, r.label, bytes(r.x)) for r in chosen.mapInArrow(run, schema).collect()))
    flat = [(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES) + 1).astype(float), y) for _, y, x in rows]
    return Field.fit([(x[:, :-1], x[:, -1], y) for x, y in flat])


COLUMNS = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "content_share": T.DoubleType()}


def annotate(docs: DataFrame, field: Field, text_col: str = "text", carry: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """Columns ``carry`` (all) of ``docs`` with the counts of the base rule, base_failed, kept and content_share.

    A document fails the base rule with fewer than MIN_WORDS words or more than MAX_REPEATED percent of its words
    in repeated windows. Of the others those are kept whose words stand in lines of content by ``share`` at least.
    Null and empty texts have no words and fail; rows are independent; input columns of the new names are replaced.
    """
    names = [c for c in (carry or docs.columns) if c not in COLUMNS]
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(k, v) for k, v in COLUMNS.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(batch.schema.get_field_index(text_col)):
                features, words, counts = describe(x.as_py() or "")
                n, again = counts[0], counts[4]
                failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
                content = sum(w for w, s in zip(words, field.decode(features), strict=True) if s) / n if n else 0.0
                rows.append((*counts, failed, not failed and content >= share, content))
            columns = zip(*rows, strict=True) if rows else [[] for _ in COLUMNS]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*names, *COLUMNS])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that annotate keeps, columns as they were."""
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(text_col).alias("__text"))
    marked = marked.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__text")
    return annotate(marked, field, "__text", ["__row"]).where("kept").select("__row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, fit(docs, read(spark, sf_dir, "labels")), carry=["doc_id"])
