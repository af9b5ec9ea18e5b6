"""Chunking as column expressions: a text becomes an array of chunks without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import token_count, tokens, truncate_tokens, words

STRATEGIES = ("fixed_size", "sentence_based", "paragraph_based", "semantic", "recursive", "markdown_header")


@dataclass(frozen=True)
class ChunkConfig:
    """Settings of a chunker; sizes in tokens."""

    strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 100
    min_chunk_size: int = 50
    max_chunk_size: int = 2000
    preserve_sentences: bool = True
    similarity_threshold: float = 0.75
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    keep_separator: bool = False
    header_levels: tuple[int, ...] = (1, 2, 3)

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if not self.min_chunk_size <= self.chunk_size <= self.max_chunk_size:
            raise ValueError("min_chunk_size <= chunk_size <= max_chunk_size is required")
        if any(not 1 <= x <= 6 for x in self.header_levels):
            raise ValueError("header levels go from 1 to 6")
        object.__setattr__(self, "header_levels", tuple(sorted(set(self.header_levels))))

    def warnings(self, chunks: int = 0) -> list[str]:
        """What to tell of these settings, and of the number of chunks that they made."""
        found = ["overlap is over half of the chunk size"] if self.chunk_overlap > 0.5 * self.chunk_size else []
        return found + ["over 200 chunks"] * (chunks > 200)


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` worked out once, however often it is used: a lambda's argument is a value."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _filled(xs: Column) -> Column:
    return F.filter(F.transform(xs, _strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """The sentences of a text: cut behind . ! or ? and white space."""
    return _filled(F.split(_strip(text), r"(?U)(?<=[.!?])\s+"))


def paragraphs(text: Column) -> Column:
    return _filled(F.split(text, r"(?U)\n\s*\n"))


def _state(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def pack(pieces: Column, size: int, joiner: str = " ") -> Column:
    """Pieces joined one after another; a chunk ends before the piece that would take it over ``size`` tokens.

    White space joins, so tokens add up and the fold carries their number.
    """

    def add(s: Column, p: Column) -> Column:
        x, n = p["x"], p["n"]
        full = (s["n"] > 0) & (s["n"] + n > size)
        return _state(
            done=F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]),
            cur=F.when(full | (s["n"] == 0), x).otherwise(F.concat(s["cur"], F.lit(joiner), x)),
            n=F.when(full, n).otherwise(s["n"] + n),
        )

    start = _state(done=_none(), cur=F.lit(""), n=F.lit(0).cast("long"))
    return F.aggregate(_counted(pieces), start, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def _counted(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.struct(x.alias("x"), token_count(x).alias("n")))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, each ``size - overlap`` (1 at least) behind the one before."""

    def of(ts: Column) -> Column:
        starts = F.when(F.size(ts) > 0, F.sequence(F.lit(1), F.size(ts), F.lit(max(1, size - overlap)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ts, i, F.lit(size)), " "))

    return let(tokens(text), of)


def by_sentence(text: Column, c: ChunkConfig) -> Column:
    return pack(sentences(text), c.chunk_size)


def fixed_size(text: Column, c: ChunkConfig) -> Column:
    plain = windows(text, c.chunk_size, c.chunk_overlap)
    if not c.preserve_sentences:
        return plain
    return let(by_sentence(text, c), lambda packed: F.when(F.size(packed) > 0, packed).otherwise(plain))


def by_paragraph(text: Column, c: ChunkConfig) -> Column:
    """Paragraphs packed; one over the maximum is cut into sentences at once, ahead of what is being packed."""

    def add(s: Column, p: Column) -> Column:
        x, n = p["x"], p["n"]
        large, full = n > c.max_chunk_size, (s["n"] > 0) & (s["n"] + n > c.chunk_size)
        return _state(
            done=F.when(large, F.concat(s["done"], pack(sentences(x), c.chunk_size))).when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]),
            cur=F.when(large, s["cur"]).when(full | (s["n"] == 0), x).otherwise(F.concat(s["cur"], F.lit("\n\n"), x)),
            n=F.when(large, s["n"]).when(full, n).otherwise(s["n"] + n),
        )

    start = _state(done=_none(), cur=F.lit(""), n=F.lit(0).cast("long"))
    return F.aggregate(_counted(paragraphs(text)), start, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Part of the distinct items of two arrays that both have."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def semantic(text: Column, c: ChunkConfig) -> Column:
    """Sentences together as long as each shares enough words with the one before and the maximum holds."""

    def add(s: Column, p: Column) -> Column:
        x, n, ws = p["x"], p["n"], p["ws"]
        cut = (s["n"] > 0) & ((jaccard(s["last"], ws) < c.similarity_threshold) | (s["n"] + n > c.max_chunk_size))
        return _state(
            done=F.when(cut, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]),
            cur=F.when(cut | (s["n"] == 0), x).otherwise(F.concat(s["cur"], F.lit(" "), x)),
            n=F.when(cut, n).otherwise(s["n"] + n),
            last=ws,
        )

    start = _state(done=_none(), cur=F.lit(""), n=F.lit(0).cast("long"), last=_none())
    pieces = F.transform(sentences(text), lambda x: F.struct(x.alias("x"), token_count(x).alias("n"), F.array_distinct(words(x)).alias("ws")))
    return F.aggregate(pieces, start, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def recursive(text: Column, c: ChunkConfig) -> Column:
    """Cut at the first separator, pieces still too long at the next, and so on; pieces are not joined again.

    The recursion is as deep as there are separators and is laid out when the expression is built.
    """

    def level(x: Column, separators: tuple[str, ...]) -> Column:
        if not separators:
            return fixed_size(x, c)
        sep = separators[0]
        ahead = F.lit(sep if c.keep_separator else "")

        def pieces(parts: Column) -> Column:
            cut = _filled(F.transform(parts, lambda p: F.when(p != "", F.concat(ahead, p)).otherwise("")))
            return F.when(F.size(parts) == 1, parts).otherwise(cut)

        deeper = lambda p: F.when(token_count(p) <= c.chunk_size, F.array(p)).otherwise(level(p, separators[1:]))
        return F.flatten(F.transform(let(F.split(x, re.escape(sep)), pieces), deeper))

    return F.when(token_count(text) <= c.chunk_size, F.array(_strip(text))).otherwise(level(text, c.separators))


def by_header(text: Column, c: ChunkConfig) -> Column:
    """A chunk for each markdown header of the set levels; one over the maximum is cut by paragraphs."""
    marks = "|".join("#" * k for k in c.header_levels) or "(?!)"

    def add(s: Column, line: Column) -> Column:
        head = F.trim(line).rlike(rf"^(?:{marks})\s+.+$") & s["any"]
        return _state(
            done=F.when(head, F.concat(s["done"], F.array(_strip(s["cur"])))).otherwise(s["done"]),
            cur=F.when(head | ~s["any"], line).otherwise(F.concat(s["cur"], F.lit("\n"), line)),
            any=F.lit(True),
        )

    start = _state(done=_none(), cur=F.lit(""), any=F.lit(False))
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    chunks = F.aggregate(lines, start, add, lambda s: F.concat(s["done"], F.array(_strip(s["cur"]))))
    return F.flatten(F.transform(chunks, lambda x: F.when(token_count(x) > c.max_chunk_size, by_paragraph(x, c)).otherwise(F.array(x))))


def overlapped(chunks: Column, c: ChunkConfig) -> Column:
    """Each chunk but the first with the end of the chunk before it in front, if it does not begin with it.

    By sentences: the last ones within the overlap, one at least, or nothing where that grows the chunk by more.
    By words: the last words.
    """
    if c.chunk_overlap <= 0:
        return chunks
    n = c.chunk_overlap

    def tail(x: Column) -> Column:
        if not c.preserve_sentences:
            return let(tokens(x), lambda ts: F.array_join(F.slice(ts, F.greatest(F.size(ts) - n + 1, F.lit(1)), F.lit(n)), " "))

        def add(s: Column, p: Column) -> Column:
            y, k = p["x"], p["n"]
            stop = s["stop"] | ((s["text"] != "") & (s["n"] + k > n))
            return _state(text=F.when(stop, s["text"]).when(s["text"] == "", y).otherwise(F.concat(y, F.lit(" "), s["text"])), n=F.when(stop, s["n"]).otherwise(s["n"] + k), stop=stop)

        return F.aggregate(F.reverse(_counted(sentences(x))), _state(text=F.lit(""), n=F.lit(0).cast("long"), stop=F.lit(False)), add, lambda s: s["text"])

    def joined(x: Column, before: Column) -> Column:
        whole = F.when((before != "") & ~x.startswith(before), F.concat(before, F.lit(" "), x)).otherwise(x)

        def fit(w: Column) -> Column:
            most = token_count(x) + n
            return F.when(token_count(w) > most, x if c.preserve_sentences else truncate_tokens(w, most)).otherwise(w)

        return let(whole, fit)

    def all_of(xs: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.transform(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), tail))
        return F.when(F.size(xs) < 2, xs).otherwise(F.zip_with(xs, before, joined))

    return let(chunks, all_of)


def merged(chunks: Column, c: ChunkConfig) -> Column:
    """A chunk under the minimum goes to the one before it; the first stays as it is."""

    def add(done: Column, x: Column) -> Column:
        small = (token_count(x) < c.min_chunk_size) & (F.size(done) > 0)
        last = F.concat(F.element_at(done, -1), F.lit(" "), x)
        return F.when(small, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(chunks, _none(), add)


CHUNKERS: dict[str, Callable[[Column, ChunkConfig], Column]] = {
    "fixed_size": fixed_size,
    "sentence_based": by_sentence,
    "paragraph_based": by_paragraph,
    "semantic": semantic,
    "recursive": recursive,
    "markdown_header": by_header,
}


def chunk(text: Column, config: ChunkConfig) -> Column:
    """array<struct<content, tokens>>: split by the strategy, overlapped, small chunks merged."""
    raw = _filled(CHUNKERS[config.strategy](F.coalesce(text, F.lit("")), config))
    return F.transform(merged(overlapped(raw, config), config), lambda x: F.struct(x.alias("content"), token_count(x).alias("tokens")))
