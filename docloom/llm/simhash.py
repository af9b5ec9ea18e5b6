"""SimHash near-dedup over a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, read, texts
from .components import components

WORDS_PER_SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Children of a node of the index; most queries of one bucket in a round; neighbours that are few; pairs held at a time; rows indexed at a time.
FANOUT, STARTS, FEW, PAIRS, CHUNK = 16, 32, 32, 4_000_000, 200_000
#: Fingerprints of a bucket from which on it is split by more bits, and how often at most.
BUCKET, SPLITS = 8_192, 3
FULL = (1 << 64) - 1
#: Kinds of candidates.
LINK, HUB = 0, 1
#: For documents alike by a Jaccard similarity: words of a shingle, that similarity, and the differing bits up to which fingerprints are candidates.
SET_WORDS, SIMILARITY, SET_BITS = 5, 0.8, 13
#: Fingerprints that a bucket of sampled bits has on average, and the part of pairs at SET_BITS that may share no bucket.
SAMPLED, MISSED = 256, 0.02
#: Hashes before one in a set's order that tell whether two sets share an earlier one.
BEFORE = 8
#: Counters of how often shingles of dense groups come; a power of two.
SLOTS = 1 << 16


def fingerprint(text: str, words: int = WORDS_PER_SHINGLE) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the text's shingles."""
    return majority(shingle_hashes(text, words))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hashes of a whole text's shingles, repeats included; a shorter text is one shingle, one without words has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    ends = list(accumulate([len(p) + 1 for p in parts]))
    k = min(words, len(parts))
    starts = [0, *ends[: len(parts) - k]]
    return np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; none of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(id, fp long) of each row. A null text has no words and so fingerprint zero."""
    schema = docs.select(F.col(id_col).alias("id")).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, in which neighbours differ in one bit."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Index of the fingerprints of many buckets at a time.

    Leaves are sorted by bucket and Gray rank. FANOUT neighbours make a node, which keeps the bits that all
    of them share; nodes make upper nodes likewise, up to one root for a bucket. Below a node only bits
    that it does not share are compared, and the differences add up on the way down: a group is left as soon as
    they pass the limit. Nodes without unvisited leaves are left too.
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes, bucket = codes[order], bucket[order]
        low = high = self.codes
        self.levels = []  # from the leaves up: bits, their mask, parent, first child, number of children, live leaves
        owner, live = bucket, np.ones(len(codes), np.int64)
        first, count = np.arange(len(codes)), np.ones(len(codes), np.int64)
        while True:
            shared = ~(low ^ high)
            self.levels.append({"bits": low & shared, "mask": shared, "first": first, "count": count, "live": live, "parent": None})
            new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
            if new.all():
                break
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
            first = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.r_[first, len(owner)])
            self.levels[-1]["parent"] = np.repeat(np.arange(len(first)), count)
            live = np.add.reduceat(live, first)
            low, high, owner = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), owner[first]
        for under, over in zip(self.levels, self.levels[1:], strict=False):  # what the parent shares is compared there
            under["own"] = under["mask"] & ~over["mask"][under["parent"]]
        if self.levels:
            self.levels[-1]["own"] = self.levels[-1]["mask"]
        self.root = np.arange(len(codes))
        for level in self.levels[:-1]:
            self.root = level["parent"][self.root]
        self.bucket_start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.bucket_size = np.diff(np.r_[self.bucket_start, len(codes)])
        self.order, self.unvisited, self.dense = order, np.ones(len(codes), bool), np.full(len(codes), -1)

    def near(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, leaf) of the same bucket within ``bits``, over unvisited leaves."""
        q, node, off = queries, self.root[queries], np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            off = off + np.bitwise_count((self.codes[q] ^ level["bits"][node]) & level["own"][node])
            keep = (off <= bits) & (level["live"][node] > 0)
            q, node, off = q[keep], node[keep], off[keep]
            if k:
                n = level["count"][node]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, off, node = np.repeat(q, n), np.repeat(off, n), np.repeat(level["first"][node], n) + inside
        return q, node

    def visit(self, leaves: np.ndarray) -> None:
        self.unvisited[leaves] = False
        for level in self.levels:
            np.subtract.at(level["live"], leaves, 1)
            if level["parent"] is not None:
                leaves = level["parent"][leaves]

    def _asks(self, cursor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next unvisited leaves of every bucket, STARTS at most and fewer in large ones, and their buckets."""
        open_ = np.flatnonzero(cursor < self.bucket_start + self.bucket_size)
        most = np.clip(PAIRS // self.bucket_size[open_], 1, STARTS)
        n = np.minimum(self.bucket_start[open_] + self.bucket_size[open_] - cursor[open_], most)
        leaves = np.repeat(cursor[open_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cursor[open_] += n
        new = self.unvisited[leaves]
        return leaves[new], np.repeat(open_, n)[new]

    def _spread(self, sources: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A search in breadth from one source a bucket: what is reached is visited and asks next, once."""
        self.visit(sources)
        self.dense[sources] = sources
        frontier, step = sources, 32
        while len(frontier):
            queries, frontier = frontier[:step], frontier[step:]
            q, leaf = self.near(queries, bits)
            step = max(step // 2, 1) if len(q) > PAIRS else min(step * 2, 1 << 14)
            reach, at = np.unique(leaf, return_index=True)
            if len(reach):
                yield q[at], reach
                self.visit(reach)
                self.dense[reach] = self.dense[q[at]]
                frontier = np.r_[frontier, reach]

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that join each bucket's leaves into its components of links of at most ``bits``.

        A leaf with few neighbours gives them all and is visited. One with many is the source of a search in
        breadth, one source a bucket at a time, that takes its whole component; its members are not
        reached again, so a dense group costs about its size and not its square. ``dense`` has the source of each
        (-1: none): of such leaves only the links of the search are given, of all others every link.
        """
        cursor = self.bucket_start.copy()
        while (cursor < self.bucket_start + self.bucket_size).any():
            asks, of = self._asks(cursor)
            if not len(asks):
                continue
            q, leaf = self.near(asks, bits)
            other = q != leaf
            q, leaf = q[other], leaf[other]
            many = asks[np.bincount(np.searchsorted(asks, q), minlength=len(asks)) > FEW]
            few = ~np.isin(q, many)
            yield q[few], leaf[few]
            self.visit(asks[~np.isin(asks, many)])
            if len(many):
                owner = of[np.searchsorted(asks, many)]
                buckets, first = np.unique(owner, return_index=True)
                yield from self._spread(many[first], bits)
                stay = self.unvisited[many]
                np.minimum.at(cursor, owner[stay], many[stay])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (mask, value, fp, ...) and bucket numbers, whole buckets at a time, of rows that come sorted by bucket."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns], 1))
        n += len(held[-1])
        if n >= CHUNK:
            rows = np.concatenate(held)
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            if len(change):
                done, held = rows[: change[-1] + 1], [rows[change[-1] + 1 :]]
                n = len(held[0])
                yield done, _numbered(done)
            else:
                held = [rows]
    if n:
        rows = np.concatenate(held)
        yield rows, _numbered(rows)


def _numbered(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(1)])


def _linked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bucket in _chunks(batches):
            index = GrayIndex(rows[:, 2].copy().view(np.uint64), bucket)
            signed = index.codes.view(np.int64)
            for a, b in index.links(bits):
                yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["u", "v"])

    return run


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` runs, each joined to the mask, as signed longs."""
    free = [b for b in range(64) if not mask >> b & 1]
    out = []
    for k in range(parts):
        m = mask | sum(1 << b for b in free[k * len(free) // parts : (k + 1) * len(free) // parts])
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) between fingerprints of ``distinct`` (fp) that join exactly those linked by ``bits`` or fewer differing bits.

    Fingerprints within ``bits`` agree in one of ``bits`` + 1 blocks of bits at least, so they share a bucket (mask,
    value under the mask). A bucket of more than BUCKET is split the same way by its other bits, which
    keeps every link; one that SPLITS rounds leave large, a dense group, is searched whole, at a cost near its size.
    """
    masks = _blocks(0, bits + 1)
    keyed = distinct.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    parts = []
    for _ in range(SPLITS):
        large = cut(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).drop("n"))
        if not large.head(1):
            break
        table = {m: _blocks(m & FULL, bits + 1) for m in masks}
        parts.append(keyed.join(large, ["mask", "value"], "left_anti"))
        finer = F.create_map(*[x for m, subs in table.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in subs]))])
        keyed = cut(keyed.join(large, ["mask", "value"], "left_semi").select(F.explode(finer[F.col("mask")]).alias("mask"), "fp").withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))
        masks = [s for subs in table.values() for s in subs]
    for part in parts:
        keyed = keyed.unionByName(part)
    keyed = keyed.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return keyed.mapInArrow(_linked(bits), "u long, v long")


def _components(nodes: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(``key``, component) for each of ``nodes`` (``key``, least): the least id of all that ``pairs`` (u, v of ``key``) join it to.

    Nodes are ordered by their least id (none last) while components are found, so the root brings the id with it.
    """
    label = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col(key).alias("key"))
    named = nodes.select(F.col(key).alias("__key"), label.alias("label"))
    for side in ("u", "v"):
        pairs = pairs.join(named, F.col(side) == F.col("__key")).drop("__key", side).withColumnRenamed("label", side)
    roots = components(pairs).select(F.col("node.key").alias("__key"), F.col("root.least").alias("component"), F.lit(True).alias("found"))
    joined = nodes.join(roots, F.col(key) == F.col("__key"), "left")
    return joined.select(key, F.when(F.col("found"), F.col("component")).otherwise(F.col("least")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS_PER_SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component) for each row: documents whose SimHash fingerprints are linked share a component.

    A fingerprint links to those at ``bits`` or fewer differing bits; ``component`` is the smallest id
    reachable by links, its own included. Copies collapse to one fingerprint before the search, so groups of any
    size cost one entry. Null and empty texts have fingerprint zero and link like any other; rows that repeat an
    id are separate documents of that id; a null id is never the smallest (a component of null ids has none).
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = cut(_components(distinct, "fp", links(distinct.select("fp"), bits)))
    return rows.join(found, "fp").select("id", "fp", "component")


def _set_id(hashes: np.ndarray) -> int:
    x = xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, node, n, fp) of each row of ``docs`` (id, text): its set of shingles, the size of that and its fingerprint."""
    schema = docs.select("id", F.lit(0).cast("long").alias("node"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_set_id(s), len(s), majority(s)) for s in (np.unique(shingle_hashes(t, words)) for t in texts(batch))]
            node, n, fp = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "node", "n", "fp"])

    return docs.select("id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of each row of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t, words)) for t in texts(batch.slice(at, 256))]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select("id", "text").mapInArrow(run, "node long, hashes array<long>")


def sampled_masks(n: int, bits: int) -> list[int]:
    """Masks of sampled bits for ``n`` fingerprints, as signed longs: so many bits that a bucket has about SAMPLED of them, so many
    masks that a pair at ``bits`` shares a bucket but for MISSED of all cases (and a nearer pair the more surely)."""
    if n <= SAMPLED:
        return [0]
    k = math.ceil(math.log2(n / SAMPLED))
    shared = math.comb(64 - bits, k) / math.comb(64, k)
    rng = np.random.default_rng(SEED)
    masks = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(math.ceil(math.log(MISSED) / math.log1p(-shared)))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucketed_by(nodes: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """``nodes`` once in each bucket of ``masks``: mask, value under the mask, fp and ``more``, sorted by bucket."""
    keyed = nodes.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp", *more)
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", *more)
    return keyed.repartition("mask", "value").sortWithinPartitions("mask", "value")


def _candidates(bits: int, similarity: float, masks: list[int]):
    """Candidates (u, v, kind) within each bucket of (mask, value, fp, node, n): nodes within ``bits`` and of fitting sizes.

    Kind LINK has all links of GrayIndex.links outside dense groups, in the bucket of the first mask that a pair shares; kind HUB has each member of a dense group with the group's
    hub, the node nearest to the majority of its bits, or with itself where that is too far, once for the buckets of a batch.
    """

    def fitting(n, a, b):
        return np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9

    every = np.array(masks, np.int64).view(np.uint64)

    def made(u, v, kind):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), kind, np.int32))], names=["u", "v", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bucket in _chunks(batches):
            index = GrayIndex(rows[:, 2].copy().view(np.uint64), bucket)
            node, n, of = rows[index.order, 3], rows[index.order, 4], rows[index.order, 0].view(np.uint64)
            for a, b in index.links(bits):
                ok = fitting(n, a, b) & ((index.dense[a] < 0) | (index.dense[b] < 0))
                a, b = a[ok], b[ok]
                shared = ((index.codes[a] ^ index.codes[b])[:, None] & every) == 0
                ok = every[shared.argmax(1)] == of[a]
                a, b = node[a[ok]], node[b[ok]]
                yield made(np.minimum(a, b), np.maximum(a, b), LINK)
            inside = np.flatnonzero(index.dense >= 0)
            inside = inside[np.argsort(index.dense[inside], kind="stable")]
            pairs = []
            for members in np.split(inside, np.flatnonzero(np.diff(index.dense[inside])) + 1) if len(inside) else []:
                middle = np.uint64(majority(index.codes[members]))
                hub = members[np.bitwise_count(index.codes[members] ^ middle).argmin()]
                ok = fitting(n, members, hub) & (np.bitwise_count(index.codes[members] ^ index.codes[hub]) <= bits)
                pairs.append(np.stack([node[members], np.where(ok, node[hub], node[members])], 1))
            if pairs:
                u, v = np.unique(np.concatenate(pairs), axis=0).T
                yield made(u.copy(), v.copy(), HUB)

    return run


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets have at least this Jaccard similarity."""
    u, v = (sets.select(F.col("node").alias(x), F.col("hashes").alias("h" + x)) for x in "uv")
    common = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(u, "u").join(v, "v").where(common >= similarity * (F.size("hu") + F.size("hv") - common) - 1e-9).select("u", "v")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often hashes come in ``sets`` (hashes), by their last bits: a table of SLOTS counts, added up in the tasks that read them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (SLOTS - 1), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py(), np.int64) for batch in batches for x in batch.column(0)), np.zeros(SLOTS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

    kind = "counts binary"
    parts = sets.select("hashes").mapInArrow(count, kind).repartition(8).mapInArrow(add, kind).collect()
    return sum((np.frombuffer(bytes(r["counts"]), np.int64) for r in parts), np.zeros(SLOTS, np.int64))


def _apart(sets: DataFrame, similarity: float, bits: int) -> DataFrame:
    """Pairs (u, v) of different roots among ``sets`` (node, hashes, fp, root) that can have this similarity and are within ``bits``.

    Hashes are put in one order, about the rarest first. Two similar sets share one of their first n - ceil(similarity * n) + 1,
    and the first that they share has few enough before it on either side; that holds in any order. Of the sets that share a hash only
    those outside the most frequent root there look for partners, so what is joined already costs nothing.
    """
    often = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k, hashes in enumerate(batch.column(1)):
                hs = hashes.values.to_numpy(zero_copy_only=False)
                n = len(hs)
                count = often.value[hs & (SLOTS - 1)]
                order = np.lexsort((hs, count))[: n - math.ceil(similarity * n - 1e-9) + 1]
                shared = np.flatnonzero(count[order] > 1)
                earlier = shared[:, None] - np.arange(BEFORE, 0, -1)
                for column, x in zip(out, (np.full(len(shared), k), np.full(len(shared), n), shared, hs[order[shared]], np.minimum(shared, BEFORE), hs[order[earlier[earlier >= 0]]]), strict=True):
                    column.append(x)
            row, n, i, h, size, before = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            row = row.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(fp[row]), pa.array(root[row]), pa.array(n.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(h.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(before.astype(np.int64)))], names=["node", "fp", "root", "n", "i", "h", "before"])

    first = cut(sets.select("node", "hashes", "fp", "root").mapInArrow(heads, "node long, fp long, root long, n long, i long, h long, before array<long>"))
    most = first.groupBy("h", "root").agg(F.count("*").alias("many")).groupBy("h").agg(F.max_by("root", F.struct("many", "root")).alias("most"), F.count("*").alias("roots"))
    met = cut(first.join(cut(most.where("roots > 1")).select("h", "most"), "h").select(*first.columns, (F.col("root") != F.col("most")).alias("asks")))
    asks = met.where("asks").select(*[F.col(c).alias(f"{c}_") for c in first.columns])
    fits = F.least("n", "n_") >= similarity * F.greatest("n", "n_") - 1e-9
    left = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_"))
    enough = left >= similarity / (1 + similarity) * (F.col("n") + F.col("n_")) - 1e-6
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= bits
    once = ~F.col("asks") | (F.col("node_") < F.col("node"))  # of two that ask for each other
    known = F.arrays_overlap("before", "before_")  # the two have met at an earlier hash
    pairs = asks.join(met, (F.col("h_") == F.col("h")) & (F.col("root_") != F.col("root")) & once & fits & enough & near & ~known)
    return pairs.select(F.least("node", "node_").alias("u"), F.greatest("node", "node_").alias("v")).distinct()


def _labels(edges: DataFrame, steps: int = 2) -> DataFrame:
    """(node, root): the least node within ``steps`` links and one of each node of ``edges`` (u, v), enough to know the members of a star by.

    Nodes of one component may still differ in it; whoever compares what differs does some work twice then.
    """
    both = cut(edges.union(edges.select("v", "u")).union(edges.select("u", "u")).union(edges.select("v", "v")).toDF("u", "v"))
    found = both.groupBy("u").agg(F.min("v").alias("root"))
    for _ in range(steps):
        found = both.join(cut(found).toDF("v", "root"), "v").groupBy("u").agg(F.min("root").alias("root"))
    return cut(found).toDF("node", "root")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SET_WORDS, similarity: float = SIMILARITY, bits: int = SET_BITS) -> DataFrame:
    """(id, node, component) for each row: documents linked by a Jaccard similarity of at least ``similarity`` share a component.

    The similarity is that of the whole sets of ``words``-word shingles. Sets are nodes with a SimHash fingerprint each (equal sets are
    one); candidates are those within ``bits`` of each other by the Gray-order index, searched in buckets of sampled bits
    (see sampled_masks), and each is compared by its whole sets before it links. A member of a dense group, where all would be near to all,
    is compared with the most frequent hub of its buckets first; what that leaves apart is compared where whole sets
    can still be similar (see _apart), so a large group of copies costs little more than its size and no link is lost.

    ``component`` is the smallest id of the group; a null id is never the smallest, and rows that repeat an id are separate documents
    of that id. Null and empty texts have the empty set, which is like itself only.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(_set_rows(named, words))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp")))
    masks = sampled_masks(nodes.count(), bits)
    met = cut(_bucketed_by(nodes, masks, "node", "n").mapInArrow(_candidates(bits, similarity, masks), "u long, v long, kind int").distinct())
    dense = met.where(F.col("kind") == HUB).select(F.col("u").alias("node")).distinct()
    hubs = met.where((F.col("kind") == HUB) & (F.col("u") != F.col("v"))).select("u", "v")
    often = cut(hubs.groupBy("v").agg(F.count("*").alias("members")))
    star = hubs.join(often, "v").groupBy("u").agg(F.max_by("v", F.struct("members", "v")).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = cut(met.where(F.col("kind") == LINK).select("u", "v").union(star).distinct())
    ids = cut(nodes.join(first.select(F.explode(F.array("u", "v")).alias("node")).union(dense).distinct(), "node", "left_semi").select("node", "least", "fp"))
    some = named.join(ids.select(F.col("least").alias("__least")).distinct(), F.col("id").eqNullSafe(F.col("__least")), "left_semi")
    sets = cut(_sets(some, words).join(ids, "node", "left_semi").groupBy("node").agg(F.any_value("hashes").alias("hashes")))
    joined = cut(_similar(first, sets, similarity))
    if dense.head(1):
        held = sets.join(ids.select("node", "fp"), "node").join(dense, "node", "left_semi").join(_labels(joined), "node", "left")
        more = _apart(held.withColumn("root", F.coalesce("root", "node")), similarity, bits)
        joined = cut(joined.union(_similar(more.join(first, ["u", "v"], "left_anti"), sets, similarity)))
    return rows.select("id", "node").join(cut(_components(nodes, "node", joined)), "node").select("id", "node", "component")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest id.

    Groups are those of near_duplicates, or with ``similarity`` those of similar_documents. Rows that repeat the kept id
    all stay; documents without an id stay only in groups without any id.
    """
    found = near_duplicates(docs, id_col, text_col, **options) if similarity is None else similar_documents(docs, id_col, text_col, similarity=similarity, **options)
    keep = found.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
