"""BPE encoding and decoding by a tokenization automaton."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Distinct words, and arcs and failed characters, whose outcome a worker remembers at most.
REMEMBERED, PAIRS = 300_000, 600_000
#: Bytes of text whose words are taken together; a longer text is taken whole.
BYTES = 1 << 20
#: A word of more bytes goes through the automaton alone.
LONG = 256
#: Bits of an outcome in a memory.
VALUE = 22
END = "</w>"
#: The splitting pattern that is read off a table of kinds of characters.
BY_KIND = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Letters that are a contraction after an apostrophe.
LETTERS = [ord(c) for c in "stmd"]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens whose accepted sequences are exactly the BPE encodings.

    It begins with a state for each symbol and arcs between all of them. Merges are added in order of rank, each by its
    gadget: for (u, v) -> w, the state of u loses arc v; the new state w copies the state of v as it is by then; and arc w
    begins wherever arc u is by then. Copies are not written out. A state keeps its default, the state it copied, with the
    rank up to which that one's losses are its own, and a list of its own losses by rank. An arc is known by its place in the order
    of the tree in which every token hangs below the token its arc was copied from, in order of rank: what one gadget takes from a
    state (arc v, and later all that begin where arc v is no more) is one interval of that order. So the compiled automaton is a few arrays
    of the size of the vocabulary, made once; whether a state has an arc is read off them.

    Symbols are the 256 bytes and the same at the end of a word (256 to 511). A word goes through a
    character table (the trie of all tokens with its failure links); at each symbol exactly one token that ends there
    continues the path of its start, and that is the transition. All tables are numpy arrays, and many words take their steps together.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        symbol = {c: b for b, c in enumerate(byte_characters())}
        size = max(vocab.values(), default=-1) + 1
        self.label = {i: t for t, i in vocab.items()}
        born, left, right = [-1] * size, [-1] * size, [-1] * size
        lost: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # of a state: the ranks of its gadgets and the arcs that they take
        spelled: dict[int, tuple[int, ...]] = {}
        for c, b in symbol.items():
            for text, s in ((c, b), (c + END, 256 + b)):
                spelled[vocab[text]], born[vocab[text]] = (s,), 0
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            lost[u].append((k, v))
            if born[w] < 0:
                born[w], left[w], right[w], spelled[w] = k, u, v, spelled[u] + spelled[v]
        self.born, self.left, self.right = born, left, right
        self.length = [len(spelled.get(t, ())) for t in range(size)]
        self._number_arcs()
        # the arcs that states have lost, as state and arc: where the interval begins, and the rank of that
        gone = sorted((u << 20 | v, self._from(v, k), k) for u, own in enumerate(lost) for v, k in {v: k for k, v in own}.items())
        self.gone, self.gone_from, self.gone_rank = np.array(gone, np.int64).reshape(-1, 3).T.copy()
        self._compile_characters(spelled)
        self.born, self.place, self.length = (np.array(x, np.int64) for x in (born, self.place, self.length))
        # of each token: the defaults of its state, each with the rank up to which its losses count, and the tokens that its arc was copied from
        self.defaults, self.until, self.default_at = self._chains(right)
        self.origins, _, self.origin_at = self._chains(left)
        if size >= 1 << 20 or len(self.fall) >= 1 << VALUE:
            raise ValueError("the vocabulary is too large for keys of these tables")
        del self.left, self.right, self.below, self.begin
        self._open()

    def _open(self) -> None:
        # what was read off the tables so far: arcs of states, characters where a failure link may be taken
        self.arcs, self.fallen = Memory(PAIRS), Memory(PAIRS)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "fallen")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _chains(self, up: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token, the one ``up`` from it and so on, one token's chain behind the other; the rank at which what is below each was made
        (no rank reaches that of a token itself); and where each token's chain begins."""
        above, token = np.array(up, np.int64), np.arange(len(up))
        at, until, levels = token, np.full(len(up), len(up) << 1), []
        while len(token):
            levels.append((token, at, until))
            until, at = self.born[at], above[at]
            token, at, until = token[at >= 0], at[at >= 0], until[at >= 0]
        token, at, until = (np.concatenate(x) for x in zip(*levels, strict=True))
        order = np.argsort(token, kind="stable")
        return at[order].astype(np.int32), until[order].astype(np.int32), np.searchsorted(token[order], np.arange(len(up) + 1))

    def _number_arcs(self) -> None:
        """Numbers the arcs so that an arc comes behind those copied from it, older ones first."""
        below: list[list[int]] = [[] for _ in self.born]
        tops = []
        for t in sorted((t for t, b in enumerate(self.born) if b >= 0), key=self.born.__getitem__):
            (below[self.left[t]] if self.left[t] >= 0 else tops).append(t)
        self.below, self.place, self.begin = below, [-1] * len(self.born), [-1] * len(self.born)
        n = 0
        for top in tops:
            stack = [(top, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    self.place[t] = n
                    n += 1
                else:
                    self.begin[t] = n
                    stack.append((t, True))
                    stack.extend((c, False) for c in reversed(below[t]))

    def _from(self, v: int, k: int) -> int:
        """Where the interval begins that a state without arc ``v`` from rank ``k`` on never has."""
        later = next((c for c in self.below[v] if self.born[c] >= k), v)
        return self.place[v] if later == v else self.begin[later]

    def _compile_characters(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """The trie of all tokens, the failure link of each node, and the tokens that end there with their lengths, longest first."""
        to: dict[int, int] = {}
        ends, depth, above = [-1], [0], [(0, 0)]
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                at = node << 9 | s
                if at not in to:
                    to[at] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                    above.append((node, s))
                node = to[at]
            ends[node] = token
        fall = [0] * len(above)
        found: list[tuple[int, ...]] = [()] * len(above)
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            up, s = above[node]
            while up:
                up = fall[up]
                if up << 9 | s in to:
                    fall[node] = to[up << 9 | s]
                    break
            found[node] = (ends[node], *found[fall[node]]) if ends[node] >= 0 else found[fall[node]]
        self.edges = np.array(sorted(to), np.int64)
        self.next = np.array([to[x] for x in self.edges.tolist()], np.int32)
        self.fall = np.array(fall, np.int32)
        self.tokens = np.fromiter(chain.from_iterable(found), np.int32)
        self.first = np.append(0, np.cumsum([len(x) for x in found]))

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The nodes to which the keys lead (node and symbol)."""
        out, rest, node, s = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys >> 9, keys & 511
        while len(rest):
            key = node << 9 | s
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[rest[hit]] = self.next[at[hit]]
            on = ~hit & (node > 0)
            rest, node, s = rest[on], self.fall[node[on]].astype(np.int64), s[on]
        return out

    def arc(self, x: int, y: int) -> bool:
        """Whether the state of token ``x`` has arc ``y``: neither it nor, up to its copying, any of its defaults has lost it."""
        return bool(self._arc(np.array([x << 20 | y]))[0])

    def _arc(self, keys: np.ndarray) -> np.ndarray:
        """The same of many keys (state and arc)."""
        out = np.ones(len(keys), bool)
        for a in range(0, len(keys), 4096):
            x, y = keys[a : a + 4096] >> 20, keys[a : a + 4096] & (1 << 20) - 1
            # every default of the state meets every token that the arc was copied from, the arc itself included
            wide = self.origin_at[y + 1] - self.origin_at[y]
            n = (self.default_at[x + 1] - self.default_at[x]) * wide
            of = np.repeat(np.arange(len(x)), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            default = self.default_at[x][of] + within // wide[of]
            lost = self.defaults[default].astype(np.int64) << 20 | self.origins[self.origin_at[y][of] + within % wide[of]]
            at = np.minimum(np.searchsorted(self.gone, lost), len(self.gone) - 1)
            taken = (self.gone[at] == lost) & (self.gone_from[at] <= self.place[y][of]) & (self.gone_rank[at] < self.until[default]) if len(self.gone) else np.zeros(len(of), bool)
            out[a + of[taken]] = False
        return out

    def run(self, word: bytes) -> np.ndarray:
        """The ids of one pre-split word: the arcs that its path takes."""
        return self.run_all(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]

    def run_all(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and where those of each word end; a word's bytes lie between two ``stops``."""
        last, size = np.zeros(len(data), np.int32), np.diff(stops)
        for word in np.flatnonzero(size > LONG).tolist():
            last[stops[word] : stops[word + 1]] = self._run_long(data[stops[word] : stops[word + 1]].tolist())
        # the longest first, so that those with an i-th symbol come first; long words are done
        order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
        begin, size = stops[:-1][order], np.where(size > LONG, 0, size)[order]
        node = np.zeros(len(order), np.int64)
        for i in range(size[0] if len(size) else 0):
            n = int(np.searchsorted(-size, -i))
            s = data[begin[:n] + i].astype(np.int64)
            s[size[:n] == i + 1] += 256
            node = self.fallen.get(node[:n] << 9 | s, self._step)
            rest, at = np.arange(n), self.first[node]
            while len(rest):
                token = self.tokens[at].astype(np.int64)
                here = begin[rest] + i
                last[here] = token
                back = self.length[token]
                inner = np.flatnonzero(back <= i)
                ok = self.arcs.get(last[here[inner] - back[inner]].astype(np.int64) << 20 | token[inner], self._arc)
                no = inner[ok == 0]
                rest, at = rest[no], at[no] + 1
        path, at, begin = np.zeros(len(data), bool), stops[1:] - 1, stops[:-1]
        begin, at = begin[at >= begin], at[at >= begin]
        while len(at):
            path[at] = True
            at = at - self.length[last[at]]
            begin, at = begin[at >= begin], at[at >= begin]
        return last[path], np.append(0, np.cumsum(path))[stops[1:]]

    def _run_long(self, word: list[int]) -> list[int]:
        """The arcs at each symbol of a word that is too long for steps in common."""
        last: list[int] = []
        node, nodes, tokens, arcs = 0, {}, {}, {}
        length = self.length.tolist()
        for i, s in enumerate(word):
            key = node << 9 | (s + 256 if i == len(word) - 1 else s)
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = int(self._step(np.array([key]))[0])
                tokens[node] = self.tokens[self.first[node] : self.first[node + 1]].tolist()
            for token in tokens[node]:
                if length[token] > i:
                    break
                pair = last[i - length[token]] << 20 | token
                ok = arcs.get(pair)
                if ok is None:
                    ok = arcs[pair] = self.arc(pair >> 20, token)
                if ok:
                    break
            last.append(token)
            if len(arcs) > PAIRS:
                arcs.clear()
            if len(nodes) > PAIRS:
                nodes.clear()
        return last


class Memory:
    """Outcomes by key in a fixed number of slots, at most ``slots``; of two keys with one slot the later stays."""

    def __init__(self, slots: int):
        self.bits = max(slots, 2).bit_length() - 1
        self.slots = np.full(1 << self.bits, -1, np.int64)  # a key and its outcome

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots >= 0))

    def get(self, keys: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The outcomes of ``keys``, those that are not remembered by ``make``."""
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        held = self.slots[at]
        out, missed = held & (1 << VALUE) - 1, np.flatnonzero(held >> VALUE != keys)
        if len(missed):
            asked, where = np.unique(keys[missed], return_inverse=True)
            out[missed] = made = make(asked).astype(np.int64)[where]
            self.slots[at[missed]] = keys[missed] << VALUE | made
        return out


def kinds() -> np.ndarray:
    """Of each code point: SPACE, LETTER, NUMBER or OTHER, as the splitting pattern tells them apart."""
    table, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, run in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(run, every):
            table[m.start() : m.end()] = kind
    return table


def split(text: str, kind_of: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of ``text`` under the pattern BY_KIND in UTF-8, and where each begins (in characters).

    A word is a run of letters, a number's one character or a run of others; an apostrophe that is a whole run takes the letters of
    a contraction with it, and what follows these begins anew. Every character but white space is in one word, so the words lie one behind
    the other in the text without its white space.
    """
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kind_of[points]
    solid = kind != SPACE
    begins = kind == NUMBER
    begins[:1] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= solid
    quote = np.flatnonzero((points == ord("'")) & begins)
    quote = quote[quote + 1 < len(points)]
    quote = quote[kind[quote + 1] == LETTER]
    one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    short = np.isin(one, LETTERS)
    long = (quote + 2 < len(points)) & np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])
    begins[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    after = after[after < len(points)]
    begins[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(begins)
    if points.dtype == np.uint8:
        width, data = solid.view(np.uint8), points[solid]
    else:
        width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)[np.repeat(solid, width)]
        width *= solid
    lengths = np.add.reduceat(width, starts, dtype=np.int64) if len(starts) else starts
    at = np.append(0, np.cumsum(lengths))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]), starts


class Tokenizer:
    """Encoder and decoder made from the text of a tokenizer file of this kind (see the class Automaton).

    Strings of added tokens, whatever they look like, are cut out of the raw text first; the rest goes through NFC, white space to
    one blank, lower case by code point and the file's splitting pattern. Texts are taken together: their words are one Arrow array, of
    which each distinct word that the memory does not hold goes through the automaton once.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton = Automaton(spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        self.labels = self.automaton.label | {i: t for t, i in self.added.items()}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.kinds = kinds() if self.pattern == BY_KIND else None
        self._open()

    def _open(self) -> None:
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in longest) + ")") if longest else None
        self.first = {x[0] for x in longest}
        self.pieces = regex.compile(self.pattern).findall
        self.space = regex.compile(r"\s+").sub
        self.spaced = pa.array([" " + self.labels.get(i, "") for i in range(max(self.labels, default=-1) + 1)], pa.large_string())
        # what is remembered: distinct words in UTF-8, and the ids of each
        self.known, self.known_ids = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.int32()))

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("added", "automaton", "labels", "pattern", "kinds")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _words(self, texts: Iterable[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
        """The pre-split words of all texts, where each text's end among them, and the places and ids of those that are added tokens."""
        parts: list[str] = []
        words: list[bytes] = []  # where the pattern is another one
        n, ends, places, ids = 0, [], [], []
        for text in texts:
            for k, part in enumerate(self.cut.split(text) if any(c in text for c in self.first) else (text,)):
                if k % 2:
                    places.append(len(words) if self.kinds is None else n + 1)
                    ids.append(self.added[part])
                    part = " x "  # holds the place of one word
                elif not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                if self.kinds is None:
                    words += [w.encode("utf-8", "surrogatepass") for w in (self.pieces(self.space(" ", part)) if k % 2 == 0 else "x")]
                else:
                    parts.append(part)
                    n += len(part)
            if self.kinds is None:
                ends.append(len(words))
            else:
                parts.append("\n")  # no word goes on into the next text
                n += 1
                ends.append(n)
        if self.kinds is None:
            return pa.array(words, pa.large_binary()), np.array(ends, np.int64), np.array(places, np.int64), ids
        found, starts = split("".join(parts), self.kinds)
        return found, np.searchsorted(starts, ends), np.searchsorted(starts, places), ids

    def encode_all(self, texts: Iterable[str]) -> tuple[pa.Array, np.ndarray]:
        """The ids of all texts one behind the other, and where those of each text end."""
        words, ends, places, added = self._words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(at.is_null())
        at_byte = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1] if len(new) else np.zeros(1, np.int64)
        data = np.frombuffer(new.buffers()[2], np.uint8)[at_byte[0] : at_byte[-1]] if at_byte[-1] else np.zeros(0, np.uint8)
        flat, stops = self.automaton.run_all(data, at_byte - at_byte[0])
        lists = pa.concat_arrays([self.known_ids, _lists(np.append(0, stops), flat), _lists(range(len(added) + 1), added)])
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(self.known) + len(new) <= REMEMBERED:
            self.known, self.known_ids = pa.concat_arrays([self.known, new]), lists[: len(self.known) + len(new)]
        else:
            self.known, self.known_ids = distinct[:REMEMBERED], lists.take(pa.array(place[:REMEMBERED]))
        of_word = place[coded.indices.to_numpy()]
        of_word[places] = len(lists) - len(added) + np.arange(len(added))
        taken = lists.take(pa.array(of_word))
        return taken.flatten(), np.append(0, np.cumsum(taken.value_lengths()))[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].to_pylist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by blanks as a file without a decoder has it."""
        return " ".join(map(self.labels.__getitem__, ids))

    def decode_all(self, flat: pa.Array, ends: np.ndarray) -> pa.Array:
        """What the ids of each text decode to, for results of encode_all."""
        labels = self.spaced.take(flat)
        at = np.frombuffer(labels.buffers()[1], np.int64)[labels.offset :][np.append(0, ends)]
        rows = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(at), labels.buffers()[2]])
        return pc.utf8_slice_codeunits(rows, 1).cast(pa.string())


def _lists(stops: Sequence[int], flat: Sequence[int]) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(stops, pa.int64()), pa.array(flat, pa.int32()))


def _shared(docs: DataFrame, path: str):
    """The tokenizer of the file ``path``, compiled once on the driver and broadcast (its size is that of the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(Tokenizer(f.read()))


def _columns(docs: DataFrame, added: dict[str, T.DataType], source: str, make) -> DataFrame:
    """``docs`` with the columns ``added``, made from ``source`` in parts of whole rows, each of about BYTES of it."""
    names = [c for c in docs.columns if c not in added]
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
            filled = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BYTES, "right")))
                part = batch.slice(at, stop - at)
                made = make(part.column(part.schema.get_field_index(source)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], *made], names=[*names, *added])
                at = stop

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` array<int>: the ids of the whole text under the tokenizer file ``path``; with ``decoded_col`` also,
    in the same pass, what they decode to.

    No special tokens are added; strings of special tokens in a text become their ids. A null or empty
    text has no ids and decodes to "". Rows are independent, so repeats, ties and any length or number of rows are
    as good as any; columns of the new names are replaced and all others pass through. The automaton is
    compiled on the driver and broadcast; executors need no copy of the file, and what a worker remembers is bounded.
    """
    shared = _shared(docs, path)

    def make(texts: pa.Array) -> list[pa.Array]:
        flat, ends = shared.value.encode_all(x.as_py() or "" for x in texts)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat)
        return [ids, shared.value.decode_all(flat, ends)] if decoded_col else [ids]

    return _columns(docs, {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {}), text_col, make)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the arc labels of ``ids_col``, joined as the file's library does. Null ids decode to ""."""
    shared = _shared(docs, path)

    def make(lists: pa.Array) -> list[pa.Array]:
        ids, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
        return [pa.array([shared.value.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())]

    return _columns(docs, {text_col: T.StringType()}, ids_col, make)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
