"""Exact and fuzzy deduplication in the order of ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .cut import cut

#: Counters of how often tokens come and least parity bits of a set (two a token, or more), powers of two; tokens of a bucket on average; pairs of sets held at a time; ids up to which they are broadcast.
SLOTS, BITS, BUCKET, PAIRS, NAMED = 1 << 20, 512, 1_000_000, 2_000_000, 500_000


def exact(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """The first document by id of each text; empty texts go. Only ids and hashes are shuffled to decide."""
    keyed = docs.select(F.col(id_col).alias("__id"), text.alias("__t")).where("__t <> ''").groupBy(F.sha2("__t", 256).alias("h")).agg(F.min("__id").alias("__id"))
    return docs.join(keyed.select("__id"), F.col(id_col) == F.col("__id"), "left_semi")


def _hashed(sets: DataFrame) -> DataFrame:
    """(id, hs) of the different ones of ``sets`` (id, ts), written down once: XXH64 of the tokens; of equal sets the smallest id."""
    return cut(sets.select("id", F.transform("ts", lambda t: F.xxhash64(t)).alias("hs")).groupBy("hs").agg(F.min("id").alias("id")).select("id", "hs"))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of token sets (id, ts: distinct and sorted) with a Jaccard similarity of ``threshold`` or more.

    Equal sets are one, that of the smallest id. Prefix filter: with tokens in one order, about the rarest first, two such sets share one of their first
    n - ceil(threshold * n) + 1. Sets that share such a token meet in its bucket, where sizes, places of the token and the tokens'
    parity bits (see _met) leave next to none but similar ones; only those are sent on, and compared by their whole sets.
    """
    return _similar(_hashed(sets), threshold)


def _similar(hashed: DataFrame, threshold: float) -> DataFrame:
    often = np.zeros(SLOTS, np.int64)
    counts = hashed.select(F.explode("hs").alias("h")).groupBy(F.col("h").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    tokens = math.ceil((1 - threshold) * int(often.sum())) + 1
    buckets = max(2 * hashed.sparkSession.sparkContext.defaultParallelism, math.ceil(tokens / BUCKET))
    kind = hashed.schema["id"].dataType.simpleString()
    heads = hashed.mapInArrow(_heads(hashed.sparkSession.sparkContext.broadcast(often), buckets, threshold), f"bucket int, id {kind}, n int, bits binary, ks array<int>, at array<int>, before array<long>")
    pairs = heads.repartition(buckets, "bucket").mapInArrow(_met(threshold), f"u {kind}, v {kind}")
    pairs = cut(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct())
    return _compared(pairs, hashed, threshold).select("a", "b")


def _compared(pairs: DataFrame, hashed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, distance) of the ``pairs`` (a, b) whose whole sets have a Jaccard similarity of ``threshold`` or more."""
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = cut(hashed.join(F.broadcast(named) if named.count() <= NAMED else named, "id", "left_semi"))
    a, b = (held.select(F.col("id").alias(x), F.col("hs").alias("h" + x)) for x in "ab")
    common, both = F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("both")
    found = pairs.join(a, "a").join(b, "b").select("a", "b", common, both).where(F.col("common") >= threshold * (F.col("both") - F.col("common")) - 1e-9)
    return found.select("a", "b", (1 - F.col("common") / (F.col("both") - F.col("common"))).alias("distance"))


def _heads(often: Broadcast, buckets: int, threshold: float):
    """Of each set (id, hs) a row for each bucket of tokens: its size, its parity bits, and the bucket's tokens among its first ones with
    their places and the token before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = batch.column(1).value_lengths().to_numpy()
                hs = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(hs)) - np.repeat(np.cumsum(n) - n, n)
                wide = BITS << np.ceil(np.log2(np.maximum(2 * n / BITS, 1))).astype(np.int64)
                ends = np.cumsum(wide)
                bits = np.zeros(wide.sum(), np.uint8)
                np.bitwise_xor.at(bits, (ends - wide)[row] + ((hs >> 20) & (wide[row] - 1)), np.uint8(1))
                bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends // 8].astype(np.int32).tobytes()), pa.py_buffer(np.packbits(bits).tobytes())])
                count = often.value[hs & (SLOTS - 1)]
                order = np.lexsort((hs, count, row))
                hs, count, before = hs[order], count[order], np.r_[0, hs[order][:-1]]
                first = np.maximum(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 1)
                kept = np.flatnonzero((place < first[row]) & (count > 1))  # a slot counted once has no partner
                bucket = (hs[kept] >> 32) % buckets
                kept, bucket = kept[order := np.lexsort((kept, bucket, row[kept]))], bucket[order]
                new = np.flatnonzero(np.r_[True, (row[kept][1:] != row[kept][:-1]) | (bucket[1:] != bucket[:-1])]) if len(kept) else np.zeros(0, np.int64)
                bounds, of = pa.array(np.r_[new, len(kept)], pa.int32()), row[kept[new]]
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(hs[kept].astype(np.int32)), pa.array(place[kept].astype(np.int32)), pa.array(before[kept]))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[new].astype(np.int32)), batch.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int32)), bits.take(pa.array(of)), *lists], names=["bucket", "id", "n", "bits", "ks", "at", "before"])

    return run


def _met(threshold: float):
    """Pairs (u, v) of sets that can be similar, of the rows of one or more buckets (see _heads).

    At a shared token of places i and j two sets have at most the lesser of n - i and n - j tokens in common from there on, which must be
    enough for the first that they share; where the tokens before are equal too, the two meet at those. Their parity bits differ in no more
    places than the sets in tokens. Pairs are made PAIRS at a time, so a token costs time but not memory by the square of its sets.
    """
    share = threshold / (1 + threshold)

    def widths_of(bits: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each width of parity bits, BITS and its doubles: the level of each row's own width, the places of the rows in a matrix of
        words, and the matrix, where wider bits are folded to this width."""
        raw = bits.to_pylist()
        level = np.log2(np.array([len(b) for b in raw]) * 8 // BITS).astype(np.int64)
        out, rows, words = [], np.zeros(0, np.int64), np.zeros((0, 2 * (BITS // 64) << int(level.max())), np.uint64)
        for wide in range(int(level.max()), -1, -1):
            own = np.flatnonzero(level == wide)
            half = words.shape[1] // 2
            words = np.concatenate([words[:, :half] ^ words[:, half:], np.frombuffer(b"".join([raw[k] for k in own]), np.uint64).reshape(len(own), half)])
            rows = np.r_[rows, own]
            place = np.zeros(len(raw), np.int64)
            place[rows] = np.arange(len(rows))
            out.append((level, place, np.asfortranarray(words)))
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(b) if (b := list(batches)) else None
        if held is None or not held.num_rows:
            return
        held = held.combine_chunks().to_batches(max_chunksize=held.num_rows)[0]
        ids, n, bits, ks, at, before = (held.column(k) for k in range(1, 7))
        size = ks.value_lengths().to_numpy()
        of = np.repeat(np.arange(len(size)), size)
        n = n.to_numpy().astype(np.int64)
        widths = widths_of(bits)
        k, i, before = (x.flatten().to_numpy(zero_copy_only=False) for x in (ks, at, before))
        order = np.lexsort((n[of], k))
        k, i, before, of = k[order], i[order].astype(np.int64), before[order], of[order]
        m = n[of]
        group = np.cumsum(np.r_[0, k[1:] != k[:-1]]) << 32
        low = np.searchsorted(group + m, group + np.ceil(threshold * m - 1e-9).astype(np.int64))
        many = np.arange(len(k)) - low  # partners of each: those before it in the group, of fitting sizes
        total = np.cumsum(many)
        begin = 0
        while begin < len(k):
            end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")), begin + 1)
            c = many[begin:end]
            y = np.repeat(np.arange(begin, end), c)
            x = np.arange(len(y)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[begin:end], c)
            begin = end
            both = m[x] + m[y]
            ok = np.minimum(m[x] - i[x], m[y] - i[y]) >= share * both - 1e-6
            ok &= ~((before[x] == before[y]) & (i[x] > 0) & (i[y] > 0)) & (of[x] != of[y])
            x, y, both = x[ok], y[ok], both[ok]
            off, level = np.zeros(len(x), np.int64), np.minimum(widths[0][0][of[x]], widths[0][0][of[y]])
            for wide, (_, place, words) in enumerate(widths):
                here = np.flatnonzero(level == wide)
                a, b = place[of[x[here]]], place[of[y[here]]]
                for word in words.T:
                    off[here] += np.bitwise_count(word[a] ^ word[b])
            ok = off <= both - 2 * np.ceil(share * both - 1e-6)
            u, v = np.unique(np.stack([of[x[ok]], of[y[ok]]]), axis=1)
            if len(u):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v))], names=["u", "v"])

    return run


def first_kept(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of ``nodes`` that are kept when each, in the order of ids, goes if a kept one before it is linked to it.

    In rounds: a node whose earlier neighbours are all gone is kept, one with a kept earlier neighbour goes.
    """
    left, kept = cut(nodes.select("id")), None
    edges = cut(edges.select("a", "b"))
    while True:
        blocked = edges.select(F.col("b").alias("id")).distinct()
        now = left.join(blocked, "id", "left_anti")
        kept = cut(now if kept is None else kept.union(now))
        gone = edges.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        left = cut(left.join(kept, "id", "left_anti").join(gone, "id", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
        if not left.head(1):
            return kept


def fuzzy(docs: DataFrame, text: Column, threshold: float = 0.95, id_col: str = "doc_id") -> DataFrame:
    """The documents kept when each, in the order of ids, goes if its word set is similar to that of a kept one before it.

    Empty texts go; texts without words stay and are compared with nothing. Documents of equal word sets are
    compared as one, of which only the first can stay.
    """
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).where("t <> ''").select("id", F.array_sort(F.array_distinct(words(F.col("t")))).alias("ts"))
    plain = rows.where(F.size("ts") == 0).select("id")
    sets = _hashed(rows.where(F.size("ts") > 0))
    kept = first_kept(sets, _similar(sets, threshold)).union(plain)
    return docs.join(kept.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left_semi")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; where that ties, a hash of the whole row decides, so reruns agree."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*[F.col(c) for c in rows.columns]), F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def minhash_pairs(sets: DataFrame, threshold: float, rows: int = 8) -> DataFrame:
    """(a, b, distance): pairs of word sets (id, ts: distinct and sorted) by min-wise hashing; may miss some, finds no false ones.

    Equal sets are one, that of the smallest id. A table's key is made of ``rows`` least hashes, so sets that are not alike hardly ever share one, and
    there are so many tables that of pairs at ``threshold`` no more than (1 - threshold) ** 8 share none, as with eight tables of a
    single least hash each. The distance is that of the whole sets.
    """
    hashed = _hashed(sets.where(F.size("ts") > 0))
    tables = max(math.ceil(8 * math.log1p(-threshold) / math.log1p(-(threshold**rows))), 1) if threshold < 1 else 1
    rng = np.random.default_rng(1)
    mixed, odd = (rng.integers(0, 1 << 64, tables * rows, np.uint64, endpoint=False) for _ in range(2))
    odd |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                n = batch.column(1).value_lengths().to_numpy()
                hs = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                keys = []
                for k in range(0, tables * rows, rows):
                    least = [np.minimum.reduceat((hs ^ mixed[j]) * odd[j], np.cumsum(n) - n) for j in range(k, k + rows)]
                    key = np.full(len(n), k, np.uint64)
                    for x in least:
                        key = (key ^ (key >> np.uint64(29)) ^ x) * np.uint64(0x9E3779B97F4A7C15)
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.tile(np.arange(len(n)), tables)))], names=["key", "id"])

    keyed = hashed.mapInArrow(run, f"key long, id {hashed.schema['id'].dataType.simpleString()}")
    met = keyed.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    first = met.select("ids", F.posexplode("ids").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")).distinct()
    return _compared(cut(pairs), hashed, threshold)
