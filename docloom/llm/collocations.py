"""Phrase collocations by hierarchical pair naming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .byte_tokens import buffers, group, slices, word_bytes
from .common import checkpoint_folder, cut, read

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Words of a chunk, in which phrases are counted before they are shuffled, and different phrases that are named at a time.
CHUNK, BUCKET = 1 << 22, 1 << 16
#: Languages up to which their sizes are broadcast.
LANGUAGES = 10_000
ENDS = ".,;:!?\n\x0b\x0c\r"
IS_WORD = word_bytes(" \t" + ENDS)
IS_END = ~word_bytes(ENDS)
CHUNKS = "chunk long, lang string, n long, seq binary, words binary"
ASKED = "chunk long, lang string, bucket long, size int, n binary, word binary, left binary, right binary"
NAMED = "chunk long, bucket long, at array<int>, ids array<long>, lang string, word array<string>, left array<long>, right array<long>, a array<long>"


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the largest needs, which the first byte names."""
    width = next(w for w in (1, 2, 3, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
    if width == 3:
        return b"\3" + x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    if x[0] != 3:
        return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)
    three = np.frombuffer(x, np.uint8, offset=1).reshape(-1, 3)
    return np.pad(three, ((0, 0), (0, 1))).view("<u4").ravel().astype(np.int64)


def _pack(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


class Chunk:
    """Texts of one language as numbers of their words, 0 between pieces."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, codes: np.ndarray, begins: np.ndarray, found: list[bytes]) -> None:
        """``begins``: whether a piece begins at the word."""
        used, inverse = np.unique(codes, return_inverse=True)
        known = np.fromiter((self.words.setdefault(found[c], len(self.words) + 1) for c in used.tolist()), np.int64, len(used))
        at = np.arange(len(codes)) + np.cumsum(begins)
        part = np.zeros(at[-1] + 1, np.int64)
        part[at] = known[inverse]
        self.parts.append(part)
        self.n += len(codes)

    def row(self, chunk: int, lang: str) -> tuple:
        return chunk, lang, self.n, _pack(_narrow(np.concatenate(self.parts))), _pack(b" ".join(self.words))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task: consecutive texts of a language, split at CHUNK words; a longer text is split between pieces of work, never
    between words that a phrase could join."""
    held: dict[str, Chunk] = {}
    made = 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal made
        made += 1
        row = held.pop(lang).row((TaskContext.get().partitionId() << 32) + made, lang)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "lang", "n", "seq", "words"])

    for batch in batches:
        langs, lang_of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True) if batch.num_rows else ((), ())
        for first, buf, offsets in buffers(batch.column(1)):
            starts, ends, rows = slices(buf, offsets, IS_WORD)
            if not len(starts):
                continue
            codes, found = group(buf, starts, ends)
            stops = np.concatenate([[0], np.cumsum(IS_END[buf])])
            begins = np.ones(len(starts), bool)
            begins[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
            of = lang_of[first + rows]
            for k in np.unique(of).tolist():
                mine, lang = of == k, str(langs[k])
                held.setdefault(lang, Chunk()).add(codes[mine], begins[mine], found)
                if held[lang].n >= CHUNK:
                    yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def local_pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts, places, pair of each place): the different pairs of neighbours that both have names."""
    ids, codes = np.unique(seq, return_inverse=True)
    places = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    keys, pair, n = np.unique(codes[places] * len(ids) + codes[places + 1], return_inverse=True, return_counts=True)
    return ids[keys // len(ids)], ids[keys % len(ids)], n, places, pair


def bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, buckets, bounds): what is dealt to each bucket, in its old order; the same for who asks and who gets the answer."""
    order = np.argsort(of, kind="stable")
    used, begin = np.unique(of[order], return_index=True)
    return order, used, np.append(begin, len(order))


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))


def _asks(chunks: DataFrame, level: int, buckets: int) -> DataFrame:
    """What each chunk has to be named, dealt to buckets by a hash: one row for each chunk and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, seq, words in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                s = _wide(_unpack(seq))
                if level == 1:
                    word = _unpack(words).split(b" ")
                    n = np.bincount(s, minlength=len(word) + 1)[1:]
                    order, used, bounds = _dealt(_word_buckets(word, buckets))
                else:
                    left, right, n, _, _ = local_pairs(s)
                    order, used, bounds = _dealt(bucket_of(left, right, buckets))
                parts = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                none = [b""] * len(used)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), chunk)),
                        pa.array([lang] * len(used), pa.string()),
                        pa.array(used),
                        pa.array(np.diff(bounds), pa.int32()),
                        pa.array([_narrow(n[p]) for p in parts], pa.binary()),
                        pa.array([b" ".join([word[i] for i in p.tolist()]) for p in parts] if level == 1 else none, pa.binary()),
                        # pairs come by their left name, so that the steps between these are small
                        pa.array([_narrow(np.diff(left[p], prepend=0)) for p in parts] if level > 1 else none, pa.binary()),
                        pa.array([_narrow(right[p]) for p in parts] if level > 1 else none, pa.binary()),
                    ],
                    names=[x.split()[0] for x in ASKED.split(", ")],
                )

    return chunks.select("chunk", "lang", "n", "seq", "words").mapInArrow(run, ASKED)


def _name(level: int, buckets: int, least: int):
    """A bucket's phrases summed over all chunks: those of ``least`` occurrences get an id, unlike any of another bucket."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        sizes = asked["size"].to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(asked.num_rows), sizes)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        langs = asked["lang"].to_pylist()
        flat = lambda name: np.concatenate([_wide(x) for x in asked[name].to_pylist()])
        n = flat("n")
        if level == 1:
            known: dict[tuple[str, bytes], int] = {}
            listed = [w for x in asked["word"].to_pylist() for w in x.split(b" ")]
            code = np.fromiter((known.setdefault((langs[r], w), len(known)) for r, w in zip(rows.tolist(), listed, strict=True)), np.int64, len(rows))
            # numbered in an order that does not hang on how rows arrive
            order = sorted(known)
            place = np.empty(len(order), np.int64)
            place[[known[k] for k in order]] = np.arange(len(order))
            code = place[code]
            lang, word, left, right = [k[0] for k in order], [k[1] for k in order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        else:
            both = np.stack([np.concatenate([np.cumsum(_wide(x)) for x in asked["left"].to_pylist()]), flat("right")])
            order = np.lexsort(both[::-1])
            new = np.ones(len(order), bool)
            new[1:] = (both[:, order[1:]] != both[:, order[:-1]]).any(0)
            code = np.empty(len(order), np.int64)
            code[order] = np.cumsum(new) - 1
            left, right = both[:, order[new]]
            lang, word = [langs[r] for r in rows[order[new]].tolist()], None
        total = np.zeros(len(left), np.int64)
        np.add.at(total, code, n)
        often = total >= least
        ids = np.where(often, (np.cumsum(often) - 1) * buckets + bucket + 1, 0)
        got = np.flatnonzero(often[code])
        got = got[np.argsort(rows[got], kind="stable")]
        used, begin = np.unique(rows[got], return_index=True)
        bounds = np.append(begin, len(got))
        # the names of the bucket come as a row for each language
        kept = np.flatnonzero(often)
        of, lang_of = np.unique([lang[i] for i in kept.tolist()], return_inverse=True) if len(kept) else (np.zeros(0, str), np.zeros(0, np.int64))
        kept = kept[np.argsort(lang_of, kind="stable")]
        edges = np.searchsorted(np.sort(lang_of), np.arange(len(of) + 1))
        answers, names, k = len(used), len(of), len(used) + len(of)
        whole = lambda x, y: np.concatenate([x, len(got) + y[1:]])
        later = np.concatenate([np.zeros(answers, np.int64), edges])
        return pa.table(
            {
                "chunk": pa.array([asked["chunk"][i].as_py() for i in used.tolist()] + [None] * names, pa.int64()),
                "bucket": pa.array([bucket] * k, pa.int64()),
                "at": _lists(at[got], np.concatenate([bounds, np.full(names, len(got))]), pa.int32()),
                "ids": _lists(np.concatenate([ids[code[got]], ids[kept]]), whole(bounds, edges), pa.int64()),
                "lang": pa.array([None] * answers + [str(x) for x in of], pa.string()),
                "word": _lists([word[i].decode() for i in kept.tolist()], later, pa.string()) if level == 1 else _lists([], np.zeros(k + 1), pa.string()),
                "left": _lists(left[kept], later, pa.int64()),
                "right": _lists(right[kept], later, pa.int64()),
                "a": _lists(total[kept], later, pa.int64()),
            }
        )

    return run


def _replace(level: int, buckets: int):
    """A chunk's sequence with the names of its phrases of ``level`` words in place of those of one word less."""

    def run(key: tuple[pa.Scalar, ...], answers: pa.Table, chunks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if answers.num_rows:
            heard = list(zip(*(answers[c].to_pylist() for c in ("bucket", "at", "ids")), strict=True))

            def names(of: np.ndarray) -> np.ndarray:
                order, used, bounds = _dealt(of)
                begin, out = dict(zip(used.tolist(), bounds.tolist(), strict=False)), np.zeros(len(of), np.int64)
                for bucket, at, ids in heard:
                    out[order[begin[bucket] + np.array(at)]] = ids
                return out

            for chunk, lang, n, seq, words in zip(*(chunks[c].to_pylist() for c in ("chunk", "lang", "n", "seq", "words")), strict=True):
                s = _wide(_unpack(seq))
                if level == 1:
                    new = np.concatenate([[0], names(_word_buckets(_unpack(words).split(b" "), buckets))])[s]
                else:
                    left, right, _, places, pair = local_pairs(s)
                    new = np.zeros(len(s), np.int64)
                    new[places] = names(bucket_of(left, right, buckets))[pair]
                out.append((chunk, lang, n, _pack(_narrow(new)), b""))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([r[i] for r in out], kinds[i]) for i, c in enumerate(CHUNKS.split(", "))})

    return run


class _Laid:
    """Chunks as a table of files in the checkpoint folder, laid out by chunk: what is asked about a chunk comes to it, it never moves itself."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.name = f"docloom_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_folder(self.spark)}/{self.name}"
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.write.format("parquet").bucketBy(files, "chunk").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _score(words: int):
    """The lowest-scoring cut of a phrase, the first of equals; numbers of up to 38 digits, so that products are exact."""
    wide = lambda x: f"CAST({x} AS DECIMAL(38,0))"
    return F.expr(
        f"array_min(transform(sequence(1, {words - 1}), k -> struct("
        f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('element_at(pre, k)')} * {wide(f'element_at(suf, {words} - k)')}) AS score, k AS k, element_at(pre, k) AS l, element_at(suf, {words} - k) AS r)))"
    )


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_words`` words.

    A-Z are lower-cased, texts split into pieces at sentence marks and line ends, pieces into words at spaces and tabs. A phrase
    found ``min_count`` times or more is a candidate; its score is floor(1000 * a * n / (l * r)) at the lowest-scoring
    cut. One that stands as often within a longer candidate goes. All counts are of whole texts and exact.

    Every frequent word has a number, in place of which chunks of texts hold it. A phrase of k words is a pair of two neighbouring names of k - 1
    words: each chunk counts its pairs, buckets of all chunks' pairs sum them, those frequent enough get the next names, and
    chunks put them in place. So phrases grow only from frequent ones, no set of names goes to all tasks, and a frequent word is
    one row a chunk. The two names of a pair are its parents: its cuts lie along the left and right ones, and a phrase is
    subsumed by the most frequent of those that name it a parent.

    A null text is empty and a null language ``und``; every row counts, repeated or not; a language without candidates, and no
    rows, give none; other columns, whatever their names, are not looked at. A text must fit a task.
    """
    kinds = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    laid = _Laid(kinds.mapInArrow(_chunks, CHUNKS))
    size = cut(laid.rows().groupBy("lang").agg(F.sum("n").alias("n")))
    beside = F.broadcast(size) if size.limit(LANGUAGES + 1).count() <= LANGUAGES else size
    words = size.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, words // BUCKET // 4)
    tables: list[DataFrame] = []
    for k in range(1, max_words + 1):
        named = cut(_asks(laid.rows(), k, buckets).groupBy("bucket").applyInArrow(_name(k, buckets, min_count), NAMED))
        rows = named.where(F.col("chunk").isNull()).select("lang", F.explode(F.arrays_zip("ids", "a", *(["word"] if k == 1 else ["left", "right"]))).alias("x"))
        if k == 1:
            t = rows.select("lang", F.col("x.ids").alias("id"), F.col("x.a").alias("a"), F.col("x.word").alias("phrase"), F.col("x.word").alias("last"), F.array("x.a").alias("pre"), F.array("x.a").alias("suf"))
        else:
            t = rows.select("lang", F.col("x.ids").alias("id"), F.col("x.a").alias("a"), F.col("x.left").alias("left"), F.col("x.right").alias("right"))
            heads = tables[-1].select(F.col("id").alias("left"), F.col("phrase").alias("head"), F.col("pre").alias("pre_head"))
            tails = tables[-1].select(F.col("id").alias("right"), "last", F.col("suf").alias("suf_tail"))
            t = t.join(heads, "left").join(tails, "right")
            t = t.select("lang", "id", "a", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("pre_head", F.array("a")).alias("pre"), F.concat("suf_tail", F.array("a")).alias("suf"), "left", "right")
        tables.append(cut(t))
        if k < max_words:
            answers = named.where(F.col("chunk").isNotNull()).select(F.col("chunk").alias("of"), "bucket", "at", "ids")
            old, laid = laid, _Laid(answers.groupBy("of").cogroup(laid.rows().groupBy("chunk")).applyInArrow(_replace(k, buckets), CHUNKS))
            old.drop()
    laid.drop()
    found = []
    for k, t in enumerate(tables[1:], 2):
        if k < max_words:
            longer = tables[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            t = t.join(longer, "id", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
        found.append(t.join(beside, "lang").select("lang", "phrase", "a", "n", _score(k).alias("best")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    ranks = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), seqs AS (SELECT lang, row_number() OVER () AS i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), words AS (SELECT lang, i, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM seqs
), totals AS (SELECT lang, count(*)::HUGEINT AS n FROM words GROUP BY ALL
), spots AS (SELECT lang, w, {", ".join(f"lead(w, {k}) OVER s AS w{k}" for k in range(1, MAX_WORDS))} FROM words WINDOW s AS (PARTITION BY i ORDER BY pos)
), phrases AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS k, [{', '.join(['w', *(f'w{j}' for j in range(1, k))])}] AS p FROM spots WHERE {'w' if k == 1 else f'w{k - 1}'} IS NOT NULL" for k in range(1, MAX_WORDS + 1))}
), counts AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING f >= {MIN_COUNT}
), cuts AS (SELECT lang, k, p, f, unnest(range(1, k)) AS c FROM counts
), scored AS (
  SELECT x.lang, x.k, x.p, x.f AS a, x.c, l.f AS l, r.f AS r, n, (1000 * x.f * n) // (l.f * r.f) AS score
  FROM cuts x JOIN totals t ON t.lang = x.lang
  JOIN counts l ON l.lang = x.lang AND l.p = x.p[1 : x.c]
  JOIN counts r ON r.lang = x.lang AND r.p = x.p[x.c + 1 : x.k]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
), begun AS (SELECT lang, f, k, p, unnest(range(1, k + 1)) AS s FROM counts
), parts AS (SELECT lang, f, k, p, s, unnest(range(s, k + 1)) AS e FROM begun
), subs AS (SELECT lang, f, p[s : e] AS p FROM parts WHERE e - s + 1 < k
), within AS (SELECT lang, p, max(f) AS f FROM subs GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.p = b.p
WHERE w.f IS NULL OR 100 * w.f < 100 * a QUALIFY rank <= {TOP}
"""
