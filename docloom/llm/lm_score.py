"""Language-model scores of whole texts by a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held_out, read, texts

#: Width of the network, and bounds of the symbols that it tells apart. Between them their number grows with the corpus (see symbols_for).
WIDTH, LEAST_SYMBOLS, MOST_SYMBOLS = 32, 256, 4_096
#: Part of the symbols that stand for the tokens without one of their own, by a hash.
HASHED = 0.25
#: Tokens whose counts every worker holds; counts of the rarer ones are joined.
HEAD = 250_000
#: Parts of the corpus that are trained on in turn, events of a step, noise classes of a step, noise symbols of a class and step, noise that counts for an event, first step size.
ROUNDS, STEP, NOISE, CLASS_NOISE, RATIO, RATE = 2, 32_768, 32, 8, 8, 0.15
#: Training tokens of a shard, which one task learns from at a time; steps that it makes at least; where the sums of squared gradients begin.
SHARD_TOKENS, LEAST_STEPS, CALM = 2_000_000, 30, 1e-6
#: Distinct tokens that a worker gathers before it passes their counts on.
HELD = 300_000
#: The end of a text as a token: no word is empty.
END = b""


def tokens(text: str) -> list[bytes]:
    """The words of a whole text with A-Z lower-cased, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, n long) over all texts of ``docs``; workers add up what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch, text_col):
                counts.update(tokens(text))
                if len(counts) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return docs.select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def symbols_for(n: int) -> int:
    """The number of symbols for a corpus of ``n`` tokens: a square that grows with the root of ``n`` between the two bounds."""
    side = 1 << math.ceil(math.log2(max(math.sqrt(n), 1)) / 2)
    return int(np.clip(side * side, LEAST_SYMBOLS, MOST_SYMBOLS))


def _add(n: int, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sums of the rows of ``x`` by their numbers ``rows``, added place by place."""
    width = x.shape[1]
    out = np.zeros(n * width, x.dtype)
    np.add.at(out, (rows[:, None] * width + np.arange(width)).ravel(), x.ravel())
    return out.reshape(n, width)


class Network:
    """The log-bilinear model: the two symbols before a place predict, linearly, the vector of the symbol there.

    With the prediction g = r1 C1 + r2 C2 the class c of a symbol scores g . Q_c + B_c and the symbol in its class g . q_w + b_w; the
    probability is the product of the softmax over the classes and that over the class, and so sums to one over all symbols. Classes
    are equally many symbols next to each other by frequency. The context len(bias) stands for what is before a text.
    """

    NAMES = ("context", "near", "far", "classes", "class_bias", "target", "bias")

    def __init__(self, counts: np.ndarray):
        """``counts``: of each symbol in the corpus; their number is a square."""
        k, rng = len(counts), np.random.default_rng(6)
        self.side = math.isqrt(k)
        share = (counts + 1.0).reshape(self.side, -1)
        self.class_noise = share.sum(1) / share.sum()
        self.noise = (share / share.sum(1, keepdims=True)).ravel()
        self.context = rng.normal(0, 0.1, (k + 1, WIDTH)).astype(np.float32)
        self.near, self.far = (np.eye(WIDTH, dtype=np.float32) * s for s in (1.0, 0.5))
        self.classes, self.target = (rng.normal(0, 0.1, (m, WIDTH)).astype(np.float32) for m in (self.side, k))
        self.class_bias, self.bias = np.log(self.class_noise).astype(np.float32), np.log(self.noise).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def copy(self) -> Network:
        own = object.__new__(Network)
        own.__dict__.update({n: x.copy() if isinstance(x, np.ndarray) else x for n, x in self.__dict__.items()})
        return own

    def train(self, codes: np.ndarray, counts: np.ndarray, seen: dict[str, np.ndarray], rng: np.random.Generator, rate: float) -> None:
        """A pass (more over few) over distinct events, codes of two context symbols and a symbol, and how often each was met.

        Noise-contrastive estimation on both levels: a class is told from draws of the class distribution, a symbol from draws of the
        distribution in its class, each draw counting for its part of RATIO; a step shares its draws. Steps are Adagrad's,
        whose sums are kept in ``seen``.
        """
        k, side = len(self.bias), self.side
        passes = max(1, LEAST_STEPS * STEP // max(len(codes), STEP))
        inner = np.cumsum(self.noise.reshape(side, -1), 1)
        class_log, log = (np.log(RATIO * x).astype(np.float32) for x in (self.class_noise, self.noise))
        tell = lambda s: 1 / (1 + np.exp(np.clip(s, -30, 30)))
        steps = (order[at : at + STEP] for _ in range(passes) for order in [rng.permutation(len(codes))] for at in range(0, len(codes), STEP))
        for some in steps:
            far, rest = np.divmod(codes[some], (k + 1) * k)
            near, w = np.divmod(rest, k)
            by = np.argsort(w, kind="stable")
            far, near, w = far[by], near[by], w[by]
            weight = counts[some][by].astype(np.float32)
            weight /= weight.sum()
            own = w // (k // side)
            guess = (self.context @ self.near)[near]
            guess += (self.context @ self.far)[far]
            # classes
            draws = rng.choice(side, NOISE, p=self.class_noise)
            kind = self.classes[own]
            hit = weight * tell(np.einsum("ij,ij->i", guess, kind) + self.class_bias[own] - class_log[own])
            miss = -(RATIO / NOISE) * weight[:, None] * tell(-(guess @ self.classes[draws].T + self.class_bias[draws] - class_log[draws]))
            toward = miss @ self.classes[draws]
            kind *= hit[:, None]
            toward += kind
            classes, class_bias = _add(side, own, hit[:, None] * guess), np.bincount(own, hit, side)
            np.add.at(classes, draws, miss.T @ guess)
            np.add.at(class_bias, draws, miss.sum(0))
            # symbols of each class; events come sorted by symbol and so by class
            here, first = np.unique(own, return_index=True)
            picks = np.stack([np.searchsorted(inner[c], rng.random(CLASS_NOISE) * inner[c, -1]) for c in here]).clip(0, k // side - 1) + here[:, None] * (k // side)
            kind = self.target[w]
            hit = weight * tell(np.einsum("ij,ij->i", guess, kind) + self.bias[w] - log[w])
            kind *= hit[:, None]
            toward += kind
            target, bias = _add(k, w, hit[:, None] * guess), np.bincount(w, hit, k)
            ends = np.r_[first[1:], len(w)]
            for c in range(len(here)):
                a, b, p = first[c], ends[c], picks[c]
                q = self.target[p]
                miss = -(RATIO / CLASS_NOISE) * weight[a:b, None] * tell(-(guess[a:b] @ q.T + self.bias[p] - log[p]))
                toward[a:b] += miss @ q
                np.add.at(target, p, miss.T @ guess[a:b])
                np.add.at(bias, p, miss.sum(0))
            # what all events ask of a context symbol is added up before it is turned to that symbol's vector and to the matrices
            at_near, at_far = _add(k + 1, near, toward), _add(k + 1, far, toward)
            context = at_near @ self.near.T + at_far @ self.far.T
            for name, g in (("classes", classes), ("class_bias", class_bias), ("target", target), ("bias", bias), ("context", context), ("near", self.context.T @ at_near), ("far", self.context.T @ at_far)):
                seen[name] = seen.get(name, np.float32(CALM)) + (g * g).astype(np.float32)
                setattr(self, name, (getattr(self, name) + rate * g / np.sqrt(seen[name])).astype(np.float32))

    def log10(self, far: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The normalised log10 probability of each symbol ``w``, in batched products over the classes and over the symbols of each class."""
        k, side = len(self.bias), self.side
        size, out = k // side, np.empty(len(w))
        before, earlier = self.context @ self.near, self.context @ self.far
        ones, dot = np.ones(size, np.float32), "ij,ij->i"

        def less_norms(value: np.ndarray, guess: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> None:
            """Takes the log of the sum of the exponentials of each row's scores from ``value``, a few rows at a time."""
            for i in range(0, len(value), 1 << 11):
                s = guess[i : i + (1 << 11)] @ vectors.T
                s += bias
                top = 0.0
                if s.max() > 60 or s.min() < -60:
                    top = s.max(1, keepdims=True)
                    s -= top
                    top = top[:, 0]
                value[i : i + (1 << 11)] -= np.log(np.exp(s, out=s) @ ones) + top

        for at in range(0, len(w), 1 << 16):
            x = w[at : at + (1 << 16)]
            by = np.argsort(x, kind="stable")
            x, own = x[by], x[by] // size
            guess = before[near[at : at + (1 << 16)][by]]
            guess += earlier[far[at : at + (1 << 16)][by]]
            value = np.einsum(dot, guess, self.classes[own]).astype(np.float64) + self.class_bias[own]
            value += np.einsum(dot, guess, self.target[x]) + self.bias[x]
            less_norms(value, guess, self.classes, self.class_bias)
            here, first = np.unique(own, return_index=True)
            for c, a, b in zip(here, first, np.r_[first[1:], len(x)], strict=True):
                less_norms(value[a:b], guess[a:b], self.target[c * size : (c + 1) * size], self.bias[c * size : (c + 1) * size])
            out[at : at + (1 << 16)][by] = value
        return out / math.log(10)


def _contexts(w: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Far and near context and symbol at each place of the symbols of texts laid end to end, which begin at ``starts``."""
    near, far = np.r_[k, w[:-1]], np.r_[k, k, w[:-2]][: len(w)]
    near[starts] = k
    far[starts] = k
    second = starts + 1
    far[second[second < len(w)]] = k
    return far, near, w


class Vocabulary:
    """Numbers of the head tokens by frequency, and the symbol of every token."""

    def __init__(self, number: dict[bytes, int], symbols: int):
        self.number, self.symbols = number, symbols
        self.own = symbols - int(symbols * HASHED)
        head = np.arange(len(number))
        self.of = np.where(head < self.own, head, 0)
        for token, i in number.items():
            if i >= self.own:
                self.of[i] = self.hashed(token)

    def hashed(self, token: bytes) -> int:
        return self.own + zlib.crc32(token) % (self.symbols - self.own)

    def symbols_of(self, words: Iterator[bytes], numbers: np.ndarray) -> np.ndarray:
        out = self.of[np.maximum(numbers, 0)] if len(self.of) else np.zeros(len(numbers), np.int64)
        rare = np.flatnonzero(numbers < 0)
        if len(rare):
            flat = list(words)
            out[rare] = [self.hashed(flat[i]) for i in rare.tolist()]
        return out


def _numbered(batch: pa.RecordBatch, number: dict[bytes, int], name: str) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, int]]:
    """Parts of a batch of at most some 500,000 tokens or one text: words, their numbers, text starts and the first row."""
    rows, size, first = [], 0, 0
    for i, text in enumerate(texts(batch, name)):
        rows.append(tokens(text))
        size += len(rows[-1])
        if size >= 500_000 or i == batch.num_rows - 1:
            get = number.get
            flat = np.fromiter(map(get, chain.from_iterable(rows), repeat(-1)), np.int64, size)
            starts = np.cumsum([0, *map(len, rows[:-1])])
            yield rows, flat, starts, first
            rows, size, first = [], 0, i + 1


def _encoded(docs: DataFrame, vocabulary: Vocabulary, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(shard, met, w) of ``docs``: one row for each shard with the symbols of its texts, in an order that ids and texts alone decide."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, numbers, starts, first in _numbered(batch, shared.value.number, "text"):
                w = shared.value.symbols_of(chain.from_iterable(rows), numbers).astype(np.int32)
                here = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array([x.tobytes() for x in np.split(w, starts[1:])], pa.binary())], names=["shard", "place", "w"])

    def gather(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("place", "ascending"), ("w", "ascending")])
        met = sum(len(x.as_py()) for x in rows["w"]) // 4
        whole = b"".join(len(x := r.as_py()).to_bytes(8, "little") + x for r in rows["w"])
        return pa.table({"shard": rows["shard"].slice(0, 1), "met": pa.array([met], pa.int64()), "w": pa.array([whole], pa.binary())})

    keyed = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).alias("shard"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("place"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "shard long, place long, w binary").groupBy("shard").applyInArrow(gather, "shard long, met long, w binary")


def _events(whole: bytes, k: int, turn: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct events, as codes, of every ``rounds``-th text of a shard from the ``turn``-th on, and how often each comes."""
    parts, starts, at, n, text = [np.zeros(0, np.int32)], [], 0, 0, 0
    while at < len(whole):
        size = int.from_bytes(whole[at : at + 8], "little")
        if text % rounds == turn:
            parts.append(np.frombuffer(whole, np.int32, size // 4, at + 8))
            starts.append(n)
            n += size // 4
        text += 1
        at += 8 + size
    far, near, w = _contexts(np.concatenate(parts).astype(np.int64), np.array(starts, np.int64), k)
    return np.unique((far * (k + 1) + near) * k + w, return_counts=True)


def train_network(docs: DataFrame, network: Network, vocabulary: Vocabulary, n: int, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """``network`` trained on every token of ``docs``, ``n`` in all.

    Texts are dealt over shards of some SHARD_TOKENS tokens by their id. In each round every shard trains a copy on its share of the
    texts, each text in one round, and copies are averaged by their tokens. Shards and the order in them follow from ids and texts alone, so another partitioning gives the same model up to the order
    in which sums of copies round. The driver gets one model of fixed size.
    """
    spark, k = docs.sparkSession, len(network.bias)
    number = max(1, math.ceil(n / SHARD_TOKENS))
    shards = cut(_encoded(docs, vocabulary, number, id_col, text_col))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, met, whole in zip(*(batch.column(c) for c in range(3)), strict=True):
                    own = shared.value.copy()
                    codes, counts = _events(whole.as_py(), k, turn, rounds)
                    if len(codes):
                        own.train(codes, counts, {}, np.random.default_rng([turn, shard.as_py()]), RATE / (1 + turn))
                    yield pa.RecordBatch.from_arrays([pa.array([float(met.as_py())]), pa.array([own.flat().tobytes()])], names=["met", "flat"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met, mean = 0.0, None
            for batch in batches:
                for m, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(x.as_py(), np.float32).astype(np.float64)
                    met += m
                    mean = x if mean is None else mean + (x - mean) * (m / met)
            if mean is not None:
                yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([mean.astype(np.float32).tobytes()])], names=["met", "flat"])

        kind = "met double, flat binary"
        # a task that has several shards averages them before they are shuffled, and none gets more models than the root of the shards
        mean = shards.mapInArrow(run, kind).mapInArrow(average, kind).repartition(math.isqrt(number) + 1).mapInArrow(average, kind).repartition(1).mapInArrow(average, kind).first()
        if mean:
            network = network.copy()
            network.load(np.frombuffer(bytes(mean["flat"]), np.float32))
    return network


class Scorer:
    """A trained network with the counts it goes with."""

    def __init__(self, network: Network, vocabulary: Vocabulary, counts: np.ndarray, rest: np.ndarray, n: int, v: int):
        """``counts``: of the head tokens by frequency; ``rest``: of each hashed symbol, the counts and number of its tokens and one; ``n``, ``v``: all and distinct training tokens."""
        self.network, self.vocabulary, self.n, self.v = network, vocabulary, n, v
        self.logs, self.rest = np.log10(counts + 1.0), np.log10(rest)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, symbols: int | None = None) -> tuple[Scorer, DataFrame]:
    """A scorer learned from every text of ``train``, and the counts (token, n) of all its tokens.

    The most frequent tokens have symbols of their own; each other token shares a symbol with those of its hash, so that all of them
    take part as contexts and as what is predicted. ``symbols`` is symbols_for all tokens unless given.
    """
    counts = cut(count_tokens(train, text_col))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    symbols = symbols or symbols_for(n)
    # the head is all tokens from some count on: the least count that keeps them within ``head``, found over the distinct counts
    falls = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy("n").agg(F.count("*").alias("tokens")).withColumn("upto", F.sum("tokens").over(falls))
    least = sizes.where(F.col("upto") <= head).agg(F.min("n")).first()[0]
    rows = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], bytes(r["token"]))) if least else []
    vocabulary = Vocabulary({bytes(r["token"]): i for i, r in enumerate(rows)}, symbols)
    known, own = np.array([r["n"] for r in rows], np.int64), vocabulary.own
    # counts and tokens by hash, less those of tokens with symbols of their own
    hashed = np.zeros((symbols - own, 2), np.int64)
    for r in counts.groupBy(F.pmod(F.crc32("token"), F.lit(symbols - own)).alias("h")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        hashed[r["h"]] = r["n"], r["v"]
    for r in rows[:own]:
        hashed[vocabulary.hashed(bytes(r["token"])) - own] -= (r["n"], 1)
    top = np.r_[np.pad(known[:own], (0, max(own - len(known), 0))), hashed[:, 0]]
    network = train_network(train, Network(top), vocabulary, n, id_col, text_col)
    return Scorer(network, vocabulary, known, hashed.sum(1) + 1, n, v), counts


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row's whole text.

    base_score adds log10((c + 1) / (n + v + 1)) over the tokens; score is the log10 probability by the network, in
    which a token without a symbol of its own has the probability of its hashed symbol times its (smoothed) share of the counts there.
    Counts of the head tokens are broadcast, a fixed number; the rest of a text's tokens are shuffled once each to meet
    theirs. A null or empty text is its end alone; repeated rows are scored one by one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        k, own_symbols = len(s.network.bias), s.vocabulary.own
        names = ["row", "id", "token", "tf", "n_tokens", "n_known", "logs", "model"]
        for batch in batches:
            for rows, numbers, starts, first in _numbered(batch, s.vocabulary.number, "text"):
                w = s.vocabulary.symbols_of(chain.from_iterable(rows), numbers)
                logs = np.where(numbers >= 0, s.logs[numbers] if len(s.logs) else 0.0, 0.0)
                each = s.network.log10(*_contexts(w, starts, k))
                shares = w >= own_symbols
                each[shares] += logs[shares] - s.rest[w[shares] - own_symbols]
                model, n = np.add.reduceat(each, starts), np.diff(np.r_[starts, len(numbers)])
                here = batch.slice(first, len(rows))
                row, ids = here.column(0), here.column(1)
                # the texts' own rows take keys that no token has, and so spread like tokens
                own = [b" %d" % r for r in row.to_pylist()]
                whole = [row, ids, pa.array(own, pa.binary()), pa.array([0] * len(rows), pa.int64()), pa.array(n, pa.int64()), pa.array(np.add.reduceat((numbers >= 0).astype(np.int64), starts)), pa.array(np.add.reduceat(logs, starts)), pa.array(model)]
                yield pa.RecordBatch.from_arrays(whole, names=names)
                # tokens beyond the head, each once for a text
                keys, rare, tf = [], [], []
                beyond = np.flatnonzero(numbers < 0)
                of = np.searchsorted(starts, beyond, "right") - 1
                listed = row.to_pylist()
                for i, places in zip(of[np.flatnonzero(np.diff(of, prepend=-1))].tolist(), np.split(beyond, np.flatnonzero(np.diff(of)) + 1), strict=False):
                    found = Counter(map(rows[i].__getitem__, (places - starts[i]).tolist()))
                    keys += [listed[i]] * len(found)
                    rare += found.keys()
                    tf += found.values()
                none = [pa.nulls(len(keys), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), ids.type), pa.array(rare, pa.binary()), pa.array(tf, pa.int64()), *none], names=names)

    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # written before anything is joined by the row numbers: a part that is read anew could be numbered in another order
    parts = cut(parts.mapInArrow(run, f"row long, id {kind}, token binary, tf long, n_tokens long, n_known long, logs double, model double"))
    log = F.when(F.col("n").isNull(), 0.0).otherwise(F.col("tf") * F.log10(F.col("n") + 1.0))
    met = parts.join(counts, "token", "left").select("row", "id", "n_tokens", "model", "tf", F.coalesce("n_known", F.when(F.col("n").isNotNull(), F.col("tf")), F.lit(0)).alias("n_known"), F.coalesce("logs", log).alias("logs"), F.when(F.col("tf") > 0, log).alias("rare"))
    each = met.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("logs").alias("logs"),
        (F.max("model") + F.coalesce(F.sum("rare"), F.lit(0.0))).alias("score"),
    )
    return each.select("id", "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * math.log10(scorer.n + scorer.v + 1)).alias("base_score"), "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, counts = fit(docs.where(~held_out(F.col("doc_id"), 7, 2)))
    out = score(docs, scorer, counts)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(int(scorer.n)).cast("long").alias("train_tokens"), "base_score", "score")
