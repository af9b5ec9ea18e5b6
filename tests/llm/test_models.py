"""Operators of free style against brute force and on hard rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, bpe, html_extract, lm_score, quality, simhash, toxicity
from docloom.llm.components import components

HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "a b c d e"), (6, "é ß \U0001f600 <|endoftext|> x"), (7, "long " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("token", F.lit("t"))


# SimHash
def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_index_joins_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = base[rng.integers(0, 40, 900)]
    for _ in range(seed):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64))
    codes = np.unique(codes)
    index = simhash.GrayIndex(codes, rng.integers(0, 3, len(codes)))
    got = [(a, b) for x, y in index.links(4) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    bucket = np.repeat(np.arange(len(index.bucket_size)), index.bucket_size)
    near = (np.bitwise_count(index.codes[:, None] ^ index.codes[None]) <= 4) & (bucket[:, None] == bucket[None])
    want = [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert roots(len(codes), got) == roots(len(codes), want)


def test_a_dense_group_costs_no_square():
    rng = np.random.default_rng(1)
    codes = np.unique(np.uint64(77) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30_000, 3)).astype(np.uint64), axis=1))
    assert sum(len(a) for a, _ in simhash.GrayIndex(codes, np.zeros(len(codes), int)).links(4)) < 3 * len(codes)


def test_fingerprints_equal_sparks_hash(spark):
    text = "The quick Brown fox jumps OVER the lazy dog"
    ws = text.lower().split()
    rows = spark.createDataFrame([(" ".join(ws[i : i + 4]),) for i in range(len(ws) - 3)], "s string").select(F.xxhash64("s")).collect()
    hashes = [r[0] & simhash.FULL for r in rows]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(" \n") == 0


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 5)  # splits buckets
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abcdefghij", k=rnd.randint(1, 5))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + HARD
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    label = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, least.get(g)) for (i, _), g in zip(rows, label, strict=True))
    assert Counter((r.id, r.component) for r in got) == want
    kept = simhash.dedup(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} - {None} == set(least.values()) and "token" in kept.columns
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(40)}


def test_pipeline_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    rows = []
    for g in range(40):
        words = [f"w{rnd.randint(0, 9000)}" for _ in range(300)]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 6):
            copy = list(words)
            for at in rnd.sample(range(300), 2 * k):
                copy[at] = f"new{rnd.randint(0, 9000)}"
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(1000 + i, t) for i, t in HARD if i is not None] + [(None, HARD[6][1]), (9000, "A  b c\nd e")]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    label = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    stages = dict(corpus_pipeline.STAGES)
    df = frame(spark, rows)
    got = stages[next(k for k in stages if "near" in k)](spark, df, "")
    kept, want = Counter(r.doc_id for r in got.collect()), Counter(i for i, _ in rows if i in set(least.values()))
    # nothing goes that has no like; of what should go at 0.8 the bits miss a few
    assert not want - kept and (kept - want).total() <= 0.06 * (len(rows) - want.total()) and got.columns == df.columns


def test_dense_groups_link_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 3)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):  # a dense group whose members are like some of it only
        copy = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 6)):
            copy[at] = f"x{rnd.randint(0, 5)}"
        rows.append((i, " ".join(copy)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    fps = [simhash.majority(np.array(sorted(s), "<u8")) for s in sets]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 13 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    label = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)])
    got = {r.id: r.component for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 1


def test_masks_keep_pairs_together():
    rng = np.random.default_rng(0)
    masks = np.array(simhash.sampled_masks(300_000, 13)).view(np.uint64)
    off = np.array([sum(1 << int(b) for b in rng.choice(64, 13, replace=False)) for _ in range(2000)], np.uint64)
    assert ((off[:, None] & masks) == 0).any(1).mean() > 0.96


def test_similar_documents_of_none(spark):
    assert simhash.dedup(frame(spark, []), similarity=0.8).count() == 0


# nearest neighbours
def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(60)]
    bad = [(-20, None), (-40, [0.0] * 16), (-60, [math.nan] * 16), (-80, [math.inf] * 16), (-100, [1.0]), (None, x[1].tolist()), (-120, [None] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    asked = sorted({r.query_id for r in got})
    assert asked == [i for i, _ in rows if i % 20 == 0]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = 0
    for q in asked:
        s = every @ every[list(ids).index(q)]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [r.score for r in mine] == pytest.approx([float(every[list(ids).index(r.vec_id)] @ every[list(ids).index(q)]) for r in mine], abs=1e-12)
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit / (20 * len(asked)) >= 0.97
    zero = sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)
    assert [r.vec_id for r in zero] == list(range(1000, 1020))


@pytest.mark.parametrize("kind", ["directions", "lengths"])
def test_recall_at_twenty_thousand_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    if kind == "directions":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 20_000)] + 0.8 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x *= np.exp(0.5 * rng.normal(size=(20_000, 1)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 200 = 0")).toPandas()
    hit = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found["vec_id"]))
    assert hit / len(got) >= 0.95


def test_repeated_ids_have_one_list(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [0.0, 5.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 1.0)]


def test_nearest_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 4.0)]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


# BPE
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary()
    ref = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    rnd = random.Random(8)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x130, 0x85, 0x200B, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x300, 0xFEFF, 0x1C, 0x1E9E, 0x2160]]
    for n in range(3000):
        text = "".join(rnd.choice(pool) if rnd.random() < 0.4 else rnd.choice("aabeinthorst' ") for _ in range(rnd.randint(0, 40)))
        text += "<|endoftext|>" * (n % 7 == 0) + "<|start"
        ids = ref.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    rows = bpe.decode(bpe.encode(frame(spark, HARD), path), path).collect()
    assert len(rows) == len(HARD) and all(r.ids == ref.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_arcs_equal_encodings_of_pairs():
    import json

    pytest.importorskip("tokenizers")
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        file = f.read()
    a = bpe.Tokenizer(file).automaton
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(file)["model"]["merges"]]
    rank = {m: k for k, m in enumerate(merges)}
    made = {x + y: (x, y) for x, y in reversed(merges)}
    spell = lambda t: spell(made[t][0]) + spell(made[t][1]) if t in made else [t]
    number = {t: i for i, t in a.label.items()}
    inner = [t for t in number if not t.endswith(bpe.END) and t in made]
    rnd = random.Random(5)
    often, rare = sorted(inner, key=lambda t: rank[made[t]])[:600], inner
    live = 0
    for n in range(6000):
        x, y = rnd.choice(often if n % 2 else rare), rnd.choice(often if n % 3 else rare)
        if n % 7 == 0:
            y = x
        # by the definition: merge the symbols of both in the order of ranks
        parts = spell(x) + spell(y)
        while True:
            best = min((p for p in zip(parts, parts[1:], strict=False) if p in rank), key=rank.__getitem__, default=None)
            if best is None:
                break
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == best:
                    parts[i : i + 2] = [best[0] + best[1]]
                i += 1
        assert a.arc(number[x], number[y]) == (parts == [x, y]), (x, y)
        live += parts == [x, y]
    assert 1000 < live < 5900


def test_tables_do_not_grow_with_words(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "PAIRS", 1000)
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        t = bpe.Tokenizer(f.read())
    nodes = len(t.automaton.next)
    rnd = random.Random(2)
    for _ in range(3000):
        t.encode("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 12))))
    assert len(t.automaton.next) == nodes and len(t.known) <= 100 and len(t.automaton.arcs) <= 1100 and len(t.automaton.fallen) <= 1100


def test_remembered_words_take_few_bytes():
    import tracemalloc

    import pyarrow as pa

    with open(bpe.vocabulary(), encoding="utf-8") as f:
        t = bpe.Tokenizer(f.read())
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("etaoinshrdlu", k=9)) for _ in range(10_000)) for _ in range(5)]
    t.encode(texts[0])
    tracemalloc.start()
    try:
        held = pa.total_allocated_bytes()
        for text in texts[1:]:
            t.encode(text)
        grown = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - held
    finally:
        tracemalloc.stop()
    assert len(t.known) > 45_000 and grown < 100 * 40_000  # of 40,000 words; objects of Python took over 300 bytes each


def test_words_go_through_the_automaton_together():
    import sys

    with open(bpe.vocabulary(), encoding="utf-8") as f:
        t = bpe.Tokenizer(f.read())
    rnd = random.Random(4)
    text, calls = " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 12))) for _ in range(20_000)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        ids = t.encode(text)
    finally:
        sys.setprofile(None)
    assert len(ids) > 20_000 and calls < 5_000


def test_split_equals_the_pattern():
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        file = f.read()
    own, plain = bpe.Tokenizer(file), bpe.Tokenizer(file)
    plain.kinds = None  # as for a file with another pattern
    rnd = random.Random(6)
    pool = [*"''stmd'relv' 0a\n\t.,<é中３½", "\u0130", "\u0300", "\u3000", "\u2028", "\x85", "\x1c", "\U0001F600", "\ud800", "<|endoftext|>", "\x00", "Σ"]
    texts = ["", "'", "'s", "''s", "'re", "'r", "'ll'", "a'sb", "'st", "x'", "'dd", "<|endoftext|>", "a<|endoftext|>'s", *("".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(4000))]
    flat, ends = own.encode_all(texts)
    other, stops = plain.encode_all(texts)
    assert flat.to_pylist() == other.to_pylist() and ends.tolist() == stops.tolist()
    for ascii_only in ([x for x in texts if x.isascii()], [], [""]):
        (flat, ends), (other, stops) = own.encode_all(ascii_only), plain.encode_all(ascii_only)
        assert flat.to_pylist() == other.to_pylist() and ends.tolist() == stops.tolist()


def test_long_words_equal_short_ones(monkeypatch):
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        a = bpe.Tokenizer(f.read()).automaton
    rnd = random.Random(7)
    words = ["".join(rnd.choices("etaoinshrdlué中=", k=rnd.randint(1, 400))).encode() for _ in range(60)]
    mixed = a.run_all(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    for long in (0, 10_000):
        monkeypatch.setattr(bpe, "LONG", long)
        flat, stops = a.run_all(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
        assert flat.tolist() == mixed[0].tolist() and stops.tolist() == mixed[1].tolist()
    assert a.run(b"").tolist() == [] and b"".join(words) and len(a.run("中".encode() * 100_000)) > 1000


def test_added_tokens_of_any_form():
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        t = bpe.Tokenizer(f.read())
    t.added = {"[SEP]": 7, "[SEP]x": 8, "§": 9}
    t.labels |= {7: "[SEP]", 8: "[SEP]x", 9: "§"}
    t._open()
    assert t.encode("[SEP]x[SEP]§") == [8, 7, 9] and t.decode([8, 9]) == "[SEP]x §"
    t.added = {}
    t._open()
    assert t.encode("a") == t.automaton.run(b"a")


# HTML
def test_extraction_of_broken_and_dressed_pages(spark):
    page = """<html><body><div class="site-header">Site <a href=x>Home</a></div><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First   <b>bold<br>line</b>.<p>Second&nbsp;one.<script>x("<p>")</script>
    <aside>Side</aside><ul><li>a<li>b</ul></article><section id="comments"><p>A reader says much more than the article does, at length, again and again.</p></section><footer>c</footer>"""
    assert html_extract.main_text(page) == "Title & more\n\nFirst bold line.\n\nSecond one.\n\na\n\nb"
    rows = [(1, None), (2, ""), (3, "plain  text"), (4, "<p>x"), (5, "<" * 1000), (6, "<div>" * 3000 + "deep"), (7, "<script>no end")]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "id long, html string").withColumn("text", F.lit("old"))).collect()}
    assert (got[1], got[2], got[3], got[4], got[6], got[7]) == ("", "", "plain text", "x", "deep", "")


def test_density_finds_an_unmarked_article():
    menu = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(20))
    body = "".join(f"<p>Paragraph {i} with quite a few words that make it plainly a paragraph.</p>" for i in range(5))
    text = html_extract.main_text(f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div></body>")
    assert text.startswith("Paragraph 0") and text.count("\n\n") == 4 and "Menu" not in text


def test_unnamed_boilerplate_beside_an_unmarked_article_goes():
    body = "".join(f"<p>Paragraph {i} with quite a few words that make it plainly a paragraph.</p>" for i in range(5))
    more = "".join(f"<p>Part two {i} with quite a few words that make it plainly one more paragraph.</p>" for i in range(5))
    teaser, legal = "<div>Read also what we wrote about other matters.</div>", "<div><p>All rights are with the owners of this site.</p></div>"
    reader = "<div><div><b>Ann</b> Nice piece.</div><div><b>Bob</b> I do not think so.</div></div>"
    for around in ("{}", "<div>{}</div>", "<div><div>{}</div></div>"):
        text = html_extract.main_text("<body>" + around.format(f"<h1>The title</h1>{teaser}<div>{body}</div>{reader}<div>{more}</div>{legal}") + "</body>")
        assert text.split("\n\n") == ["The title", *(f"Paragraph {i} with quite a few words that make it plainly a paragraph." for i in range(5)), *(f"Part two {i} with quite a few words that make it plainly one more paragraph." for i in range(5))]
    lines = "A line of an article that has no paragraphs at all.<br>" * 4
    assert html_extract.main_text(f"<body>{teaser}<div>{lines}</div>{legal}</body>") == lines.replace("<br>", " ").strip()
    reply = "<p>A reader answers at a length that no paragraph of the article has, again and again, without an end.</p>" * 9
    assert html_extract.main_text(f"<body><div><article><p>Short.</p></article><div>{reply}</div></div></body>") == "Short."


PARAGRAPHS = [f"Paragraph {i} with quite a few words that make it plainly a paragraph." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=x>Home</a></nav><form>{BODY}<input value=x><button>Go</button></form>",
        f"<nav><a>Home</a></nav><div class='social-history'>{BODY}</div><footer>f</footer>",
        f"<div id='search-results-article'>{BODY}</div>",
        f"<div class='cookie-notice'>We use cookies.</div><div class='promotion'>{BODY}</div>",
        f"<article>{BODY}<div class='ad-box'>Buy</div><form>Subscribe <input></form><div class='post-comments'>I say</div></article>",
        f"<main><div>Read also what others wrote.</div><div>{BODY}</div></main>",
        f"<article><p>{PARAGRAPHS[0]}</p>{BODY[len(PARAGRAPHS[0]) + 7 : -len(PARAGRAPHS[4]) - 7]}<p class='promotion-history'>{PARAGRAPHS[4]}</p></article>",
    ],
)
def test_names_never_cost_the_article(page):
    assert html_extract.main_text(f"<body>{page}</body>").split("\n\n") == PARAGRAPHS


@pytest.mark.parametrize("page", ["<a b " * 200_000, "<" * 1_000_000, "<b>" * 100_000 + "<h1></h1>" * 40_000, "<p><div>" + "<b>" * 80_000 + "<h1></h1>" * 40_000, "<i><div>" + "<b>" * 80_000 + "</i>" * 40_000, "<div>" * 80_000 + "</p>" * 80_000, "<a b='" * 100_000, "<!--" * 200_000, "<li>" * 80_000, "<a " + "=" * 500_000])
def test_broken_pages_cost_no_square(page):
    import time

    start = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - start < 20


def test_densities_against_brute_force():
    rnd = random.Random(12)

    def grow(depth):
        kind = rnd.choice(["div", "section", "p", "a", "b", "text", "text"]) if depth < 5 else "text"
        if kind == "text":
            return " ".join(["word"] * rnd.randint(1, 12))
        inner = [grow(depth + 1) for _ in range(rnd.randint(1, 4))] if kind in ("div", "section") else [" ".join(["word"] * rnd.randint(0, 9))]
        return (kind, inner)

    html = lambda t: t + " " if isinstance(t, str) else f"<{t[0]}>{''.join(map(html, t[1]))}</{t[0]}>"

    def count(t, linked=False):  # characters, characters in links, tags, links
        if isinstance(t, str):
            n = len(t.replace(" ", ""))
            return np.array([n, n * linked, 0, 0])
        own = sum((count(x, linked or t[0] == "a") + np.array([0, 0, not isinstance(x, str) and x[0] not in ("a", "b"), not isinstance(x, str) and x[0] == "a"]) for x in t[1]), np.zeros(4, int))
        return own

    def density(n, ratio):
        c, lc, tags, lt = n.tolist()
        if not c:
            return 0.0
        return c / max(tags, 1) * math.log(max(c / max(lc, 1) * max(tags, 1) / max(lt, 1), 1) + 1) / math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)

    for _ in range(60):
        tree = ("div", [grow(1) for _ in range(rnd.randint(2, 5))])
        whole = count(tree)
        ratio = whole[1] / max(whole[0], 1)
        nodes = html_extract._ordered(html_extract._Tree(html(tree)).root)
        html_extract._mark_noise(nodes)
        html_extract._measure(nodes)
        todo = [(tree, nodes[1])]
        while todo:
            t, node = todo.pop()
            assert node.density == pytest.approx(density(count(t, node.tag == "a"), ratio))
            blocks = [x for x in t[1] if not isinstance(x, str) and x[0] not in ("a", "b")]
            if t[0] in ("div", "section"):
                loose = sum((count((t[0], [x])) for x in t[1] if isinstance(x, str) or x[0] in ("a", "b")), np.zeros(4, int))
                loose[2] = 0
                want = sum(density(count(x), ratio) for x in blocks) + density(loose, ratio)
                assert node.sum == pytest.approx(want)
            todo.extend(zip((x for x in t[1] if not isinstance(x, str)), (c for c in node.children if not isinstance(c, str)), strict=True))


def test_lists_of_links_in_an_article_stay():
    links = "<ul><li><a href=a>First source of the story</a><li><a href=b>Second source of the story</a></ul>"
    table = "<table><tr><td><a href=c>One</a></td><td><a href=d>Two</a></td></tr></table><p><a href=e>Here</a> <a href=f>and there</a></p>"
    page = f"<body><div>{links}</div><article><p>The story itself is told in this paragraph.</p>{links}{table}</article><div>{links}</div></body>"
    for tag in ("article", "main"):
        text = html_extract.main_text(page.replace("article", tag))
        assert text.split("\n\n") == ["The story itself is told in this paragraph.", "First source of the story", "Second source of the story", "One Two", "Here and there"]


# quality
def test_counts_against_brute_force():
    rnd = random.Random(9)
    for _ in range(60):
        text = "\n".join(" ".join(rnd.choices(["a", "b", "c#", "é|"], k=rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9)))
        ws = text.split()
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
        lines = text.split("\n")
        dups = sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
        got = quality.describe(text)[2]
        assert got == (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        e = x @ field.weights
        value = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(2**n)), key=value)
        assert field.decode([tuple(r) for r in x]) == best


def labelled(spark):
    rnd = random.Random(1)
    good = [(i, "\n".join(" ".join(rnd.choices(["rain", "falls", "on", "the", "quiet", "old", "town"], k=9)) + "." for _ in range(4)), 1) for i in range(40)]
    bad = [(100 + i, "\n".join("BUY!! " + "NOW!! " * 8 + "| $$$" for _ in range(4)) + str(i), 0) for i in range(40)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, quality int")


def test_field_tells_content_from_boilerplate(spark):
    rows = labelled(spark)
    field = quality.fit(rows, rows)
    new = spark.createDataFrame([(1, "The old town sleeps and the rain falls on it all night long.\nNo one hears it but the cats of the quiet streets by the river."), (2, "WIN!! CASH!! | $$$ PRIZE!! | $$$ FREE!! | $$$ CLICK!! | $$$ HERE!! | $$$ TODAY!! | $$$ FAST!! | $$$ MORE!! | $$$")], "doc_id long, text string")
    assert {r.doc_id for r in quality.keep_good(new, field).collect()} == {1}
    out = {r.doc_id: r for r in quality.annotate(frame(spark, HARD).withColumn("kept", F.lit("x")), field).collect()}
    assert out[1].base_failed and out[7].base_failed and not out[2].kept
    none = quality.fit(rows, rows.where("false"))
    assert quality.keep_good(new, none).count() == 2
    assert quality.keep_good(new.where("false"), field).count() == 0


def test_gradient_of_the_field():
    rng = np.random.default_rng(4)
    f = len(quality.FEATURES)
    X, live = rng.normal(size=(5, 4, f)), np.arange(4) < np.array([4, 3, 1, 2, 4])[:, None]
    gold = np.eye(2)[rng.integers(0, 2, (5, 4))] * live[:, :, None]
    X = X * live[:, :, None]
    share, theta = rng.random(5), rng.normal(size=2 * f + 4) * 0.3
    _, g = quality.likelihood(theta, X, live, gold, share)
    for k in [0, 3, 2 * f - 1, *range(2 * f, 2 * f + 4)]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (quality.likelihood(theta + d, X, live, gold, share)[0] for d in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_an_article_with_a_boilerplate_tail_is_split(spark):
    rnd = random.Random(21)
    prose = lambda: " ".join(rnd.choices(["rain", "falls", "on", "the", "quiet", "old", "town"], k=12)) + "."
    junk = lambda: " | ".join(rnd.choices(["Home", "About", "LOGIN", "CONTACT", "Terms", "MAP"], k=7)) + " |"
    rows = [(i, "\n".join([prose() for _ in range(6)] + [junk() for _ in range(rnd.randint(0, 2))]), 1) for i in range(60)]
    rows += [(100 + i, "\n".join([prose() for _ in range(rnd.randint(0, 2))] + [junk() for _ in range(6)]), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality.fit(df, df)
    lines = [prose() for _ in range(5)] + [junk() for _ in range(4)]
    features, words, _ = quality.describe("\n".join(lines))
    assert field.decode(features) == [1] * 5 + [0] * 4
    row = quality.annotate(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), field).first()
    assert row.kept and row.content_share == pytest.approx(sum(words[:5]) / sum(words)) and 0 < row.content_share < 1


# toxicity
def test_index_returns_the_exact_neighbours():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(900):
        t = rng.choice(50, rng.integers(0, 6), replace=False)
        w = np.abs(rng.normal(size=len(t)))
        vectors.append((t, w / max(np.sqrt((w * w).sum()), 1e-300)))
    index = toxicity.BlockMaxIndex(vectors, 50)
    dense = np.zeros((900, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for n, (t, w) in enumerate(vectors[:120]):
        s = dense @ dense[n]
        without = n if n % 2 else -1
        want = [i for i in np.lexsort((np.arange(900), -s.round(9))) if s[i] > 1e-12 and i != without][:10]
        got = index.nearest((t, w), 10, without)
        assert [round(x, 9) for x, _ in got] == [round(float(s[i]), 9) for i in want] and len({i for _, i in got}) == len(got)


def test_score_and_calibration_by_brute_force(spark):
    rnd = random.Random(16)
    plain = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(plain, k=30) + ["vile"] * rnd.randint(1, 3) * (i % 3 == 0)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    # terms and weights by their definition
    counts = [toxicity.count_terms(t) for _, t, _ in rows]
    y, n = np.array([y for _, _, y in rows]), len(rows)
    weight = {}
    for t in set().union(*counts):
        has = np.array([t in c for c in counts])
        d = int(has.sum())
        if toxicity.MIN_EXAMPLES <= d < n:
            a = int((has & (y == 1)).sum())
            chi = n * (a * (n - y.sum()) - (d - a) * y.sum()) ** 2 / (y.sum() * (n - y.sum()) * d * (n - d))
            if chi > toxicity.CHANCE:
                weight[t] = (math.log((n + 1) / (d + 1)) + 1) * (chi - toxicity.CHANCE) / n
    assert set(weight) == set(model.number)
    for (_, text, _), c in zip(rows, counts, strict=True):
        assert model.count(text) == {model.number[t]: n for t, n in c.items() if t in weight}
    terms = sorted(weight)
    x = np.array([[(1 + math.log(c[t])) * weight[t] if t in c else 0.0 for t in terms] for c in counts])
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    got = {r.id: r for r in toxicity.score(df, model).collect()}
    votes = []
    for i, (doc, _, _) in enumerate(rows):
        s = x @ x[i]
        best = [k for k in np.lexsort((np.arange(n), -s.round(12))) if s[k] > 1e-12][:10]
        if not best:
            assert got[doc].score == model.alone
            votes.append(0.0)
            continue
        w = np.array([s[k] / (1.05 - s[k]) for k in best])
        vote = float(w @ y[best] / w.sum())
        votes.append(vote)
        assert got[doc].score == pytest.approx(1 / (1 + math.exp(-(model.slope * vote + model.shift))), abs=1e-6)
    assert model.slope > 0 and min(v for v, yy in zip(votes, y, strict=True) if yy) > max(v for v, yy in zip(votes, y, strict=True) if not yy)
    assert got[0].evidence[0].label == 1 and "vile" in got[0].terms


def test_votes_hold_on_new_texts(spark):
    rnd = random.Random(6)
    plain = [f"w{i}" for i in range(60)]
    make = lambda i, y: (i, " ".join(rnd.choices(plain, k=40) + (rnd.choices(["vile", "filthx", "filthy"], k=4) if y else [])), y)
    rows = [make(i, i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 300"))
    got = {r.id: r for r in toxicity.score(df, model).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, _, y in rows)
    assert got[0].evidence[0].label == 1 and {"vile", "filthx", "filthy"} & set(got[0].terms)
    hard = toxicity.score(frame(spark, HARD), model).collect()
    assert len(hard) == len(HARD) and all(0 <= r.score < 0.7 for r in hard)
    assert toxicity.score(frame(spark, []), model).count() == 0
    blank = toxicity.fit(df, df.where("false"))
    assert all(r.score == blank.alone for r in toxicity.score(df, blank).collect())


# language model
def test_scores_against_brute_force(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(["the", "cat", "Sat", "on"], k=rnd.randint(0, 30)) + [f"rare{rnd.randint(0, 400)}"]) for _ in range(300)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer, counts = lm_score.fit(train, head=20, symbols=16)
    own = Counter(t for x in texts for t in lm_score.tokens(x))
    n, v = sum(own.values()), len(own)
    assert (scorer.n, scorer.v) == (n, v) and len(scorer.vocabulary.number) <= 20
    rows = [(1000 + i, t) for i, t in enumerate(texts[:50])] + [(60, "the unknown cat"), *HARD]
    got = lm_score.score(frame(spark, rows), scorer, counts).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    for i, t in rows:
        ts = lm_score.tokens(t or "")
        want = sum(math.log10((own[x] + 1) / (n + v + 1)) for x in ts)
        for r in by[i]:
            assert (r.n_tokens, r.n_known) == (len(ts), sum(own[x] > 0 for x in ts)) and r.base_score == pytest.approx(want, rel=1e-9)
    # the score by the definition: two softmaxes over all classes and all symbols of the class, and the share in a hashed symbol
    net, voc = scorer.network, scorer.vocabulary
    frequent = sorted(own, key=lambda t: (-own[t], t))[: min(voc.own, len(voc.number))]
    symbol = lambda t: frequent.index(t) if t in frequent else voc.hashed(t)
    size = len(net.bias) // net.side
    for i, t in rows:
        near = far = len(net.bias)
        want = 0.0
        for x in lm_score.tokens(t or "")[:200]:
            w = symbol(x)
            g = net.context[near].astype(float) @ net.near + net.context[far].astype(float) @ net.far
            a, b = g @ net.classes.T + net.class_bias, g @ net.target.T + net.bias
            inside = slice(w // size * size, w // size * size + size)
            want += (a[w // size] - np.log(np.exp(a).sum()) + b[w] - np.log(np.exp(b[inside]).sum())) / math.log(10)
            if w >= voc.own:
                shared = [u for u in own if u not in frequent and voc.hashed(u) == w]
                want += math.log10((own[x] + 1) / (sum(own[u] for u in shared) + len(shared) + 1))
            far, near = near, w
        if len(lm_score.tokens(t or "")) <= 200:
            assert all(r.score == pytest.approx(want, rel=1e-4) for r in by[i])
    assert all(by[1000 + i][0].score < 0 for i in range(50))


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 700)
    rnd = random.Random(17)
    df = spark.createDataFrame([(i, " ".join(rnd.choices(["a", "b", "c", "d", "e"], [5, 4, 3, 2, 1], k=rnd.randint(0, 30)))) for i in range(200)], "doc_id long, text string")
    got = []
    for parts in (1, 5):
        scorer, counts = lm_score.fit(df.repartition(parts), symbols=16)
        got.append({r.id: r.score for r in lm_score.score(df, scorer, counts).collect()})
    assert got[0] == pytest.approx(got[1], rel=1e-5)


def test_training_learns_what_follows_what():
    k = 16
    net, rng = lm_score.Network(np.full(k, 100.0)), np.random.default_rng(0)
    near = np.arange(k)
    far, w = (near - 3) % k, (near + 3) % k
    before = net.log10(far, near, w).mean()
    net.train((far * (k + 1) + near) * k + w, np.full(k, 50), {}, rng, lm_score.RATE)
    assert before == pytest.approx(math.log10(1 / k), abs=0.05) and net.log10(far, near, w).mean() > before + 0.3


def test_probabilities_sum_to_one():
    net = lm_score.Network(np.arange(1, 17).astype(float))
    far, near = np.repeat([16, 3], 16), np.repeat([16, 1], 16)
    p = 10 ** net.log10(far, near, np.tile(np.arange(16), 2))
    assert p.reshape(2, 16).sum(1) == pytest.approx([1, 1])


def test_symbols_grow_with_the_corpus():
    got = [lm_score.symbols_for(n) for n in (0, 1, 10**4, 10**6, 10**8, 10**12)]
    assert got == sorted(got) and got[0] == lm_score.LEAST_SYMBOLS and got[-1] == lm_score.MOST_SYMBOLS and all(math.isqrt(k) ** 2 == k for k in got)
