"""Source divergence, licence scans and phrase collocations against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import byte_tokens, collocations, divergence, licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    vocab = ["Rain", "falls", "on", "THE", "quiet", "town", "rivière", "été", "ß", "x1y", "naïve-ish", "\U0001f600"]
    rows = []
    for i in range(120):
        words = rnd.choices(vocab, weights=range(12, 0, -1), k=rnd.randint(0, 40))
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", ", ", ".\n", " - "]) for w in words)
        rows.append((i, text, rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "a", "b", "c", None, "é"])))
    rows += [(200, None, "en", "a"), (201, "", "xx", "only"), (202, " \t\n.", "en", "none"), (3, rows[3][1], rows[3][2], rows[3][3]), (3, rows[3][1], rows[3][2], rows[3][3])]
    rows += [(None, "rain falls on the town", "en", "b"), (203, "long rain falls " * 30_000, "en", "a"), (204, "one", "yy", "p"), (205, "two", "yy", "q")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("audit")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d)


def odd(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for name in ("id", "term", "n", "chunk", "bucket", "block", "rank", "value", "item", "part", "phrase", "found", "a", "l", "r"):
        df = df.withColumn(name, F.lit("x"))
    return df


def by_sql(folder, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con.sql(sql)


def test_slices_equal_a_regular_expression_on_any_bytes():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("aB1. \n\té\U0001f600,", k=rnd.randint(0, 30))) for _ in range(300)] + [None, "", "a" * 100]
    for limit in (1, 50, 10_000):
        got = []
        for first, buf, offsets in byte_tokens.buffers(pa.array(texts).slice(5), limit):
            starts, ends, rows = byte_tokens.slices(buf, offsets, divergence.TERM)
            codes, found = byte_tokens.group(buf, starts, ends, lambda x: len(x) % 2)  # nearly everything collides
            assert [found[c] for c in codes] == [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] and len(set(found)) == len(found)
            got += [(first + r, found[c].decode()) for r, c in zip(rows.tolist(), codes.tolist(), strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts[5:]) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))]


def test_shares_are_exact():
    rnd = random.Random(2)
    totals = [rnd.randint(1, 9 * 10**15) for _ in range(500)] + [1, 2, 10**9]
    counts = [rnd.randint(0, t - 1) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + (10**9 * (c + 1)) // t for c, t in zip(counts, totals, strict=True)]


def brute_divergence(docs, min_docs):
    count, df, groups = Counter(), Counter(), set()
    for _, t, lang, s, _ in docs:
        lang, s = lang or "", s or ""
        groups.add((lang, s))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
        for w in words:
            count[lang, s, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        v = len(kept)

        def share(c, n):
            return 1 + 10**9 * (c + 1) // (n + v)

        size = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = {s: [share(count[lang, s, w], size[s]) for w in kept] for s in sources}
        q = [share(sum(count[lang, s, w] for s in sources), sum(size.values())) for w in kept]
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(w, (a - b) ** 2 // b) for w, a, b in zip(kept, p[s], q, strict=True) if count[lang, s, w] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, w, f, i + 1) for i, (w, f) in enumerate(items) if part == "pair" or i < divergence.TOP}
    return out


def test_divergence_against_brute_force_in_blocks(spark, docs, monkeypatch):
    for block, held, least in ((1 << 14, 1 << 20, 3), (4, 16, 2)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "HELD", held)
        rows = divergence.audit(odd(spark, docs), min_docs=least).collect()
        assert {tuple(r) for r in rows} == brute_divergence(docs, least) and len(rows) == len({tuple(r)[:4] for r in rows})


def test_divergence_keeps_the_first_terms_only_and_ties_by_bytes(spark):
    rows = [(i, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", "a", 0) for i in range(3)] + [(9, "é z", "en", "b", 0)]
    got = divergence.audit(spark.createDataFrame(rows, DOCS)).where("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert len(got) == 0 or [r.item for r in got] == sorted(r.item for r in got)[:200]
    rows += [(10 + i, "zz yy " * 50, "en", "b", 0) for i in range(3)]
    got = divergence.audit(spark.createDataFrame(rows, DOCS)).where("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert len(got) == 200 and [r.item for r in got] == sorted(r.item for r in got)


def test_op11_equals_its_sql(spark, folder):
    df = divergence.op11_divergence(spark, folder)
    assert [dict(df.dtypes)[c] for c in ("lang", "source", "part", "item", "value", "rank")] == ["string"] * 4 + ["bigint", "int"]
    assert Counter(map(tuple, df.collect())) == Counter(by_sql(folder, divergence.ORACLE).fetchall())


def brute_phrases(docs, least, top):
    counts, n = Counter(), Counter()
    for _, t, lang, _, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(t)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                counts.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = []
    for lang in n:
        cands = {p: f for (x, p), f in counts.items() if x == lang and f >= least and len(p) > 1}
        rows = []
        for p, a in cands.items():
            if any(len(o) > len(p) and f >= a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, f in cands.items()):
                continue
            score, k = min((int(Fraction(1000 * a * n[lang], counts[lang, p[:k]] * counts[lang, p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def test_phrases_against_brute_force_in_small_chunks_and_buckets(spark, docs, monkeypatch):
    few = [d for d in docs if d[0] != 203] + [(300, "new york city hall, new york " * 40 + "\nlast line", "en", "a", 0)]
    want = brute_phrases(few, 5, 50)
    assert any(len(r[2].split()) == 4 for r in want)
    for chunk, bucket in ((1 << 20, 1 << 16), (100, 1)):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "BUCKET", bucket)
        rows = collocations.mine(odd(spark, few), min_count=5, top=50).collect()
        assert sorted(map(tuple, rows)) == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 4 * 10**15 + 3, 9 * 10**18 + 5, 5 * 10**15 + 1, 7 * 10**15 + 9
    row = spark.createDataFrame([(a, n, [left, a], [right, a])], "a long, n long, pre array<long>, suf array<long>").select(collocations._score(2).alias("b")).first().b
    assert row.score == 1000 * a * n // (left * right) and (row.l, row.r) == (left, right)


def test_op13_equals_its_sql(spark, folder):
    df = collocations.op13_collocations(spark, folder)
    assert [dict(df.dtypes)[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")] == ["string", "bigint", "string"] + ["bigint"] * 5
    rows = df.collect()
    assert rows and Counter(map(tuple, rows)) == Counter(by_sql(folder, collocations.ORACLE).fetchall())


def pattern(node):
    kind = node[0]
    if kind == "all":
        return "".join(map(pattern, node[1]))
    if kind == "word":
        return re.escape(node[1]) + " "
    if kind == "gap":
        return rf"(?:[^ ]+ ){{{node[1]},{node[2]}}}"
    return "(?:" + "|".join(map(pattern, node[1])) + ")"


def brute_matches(text, names, texts):
    words = licenses.WORDS.findall(ascii_lower(text))
    line, starts, at = " ".join(words) + " ", [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    place = {s: i for i, s in enumerate(starts)} | {at: len(words)}
    found = set()
    for kind, label, markup in [("name", k, v) for k, v in names.items()] + [("text", k, v) for k, vs in texts.items() for v in vs]:
        p = re.compile(pattern(licenses.parse(markup)))
        for s in starts:
            ends = [e for e in place if e > s and p.fullmatch(line, s, e)] if p.match(line, s) else []
            if ends:
                found.add((kind, label, place[s], place[max(ends)]))
    return len(words), found


def test_automata_equal_regular_expressions(spark):
    names = {"ab": "a b", "b": "b"}
    texts = {"t1": ("a [[b [[c]]]] d", "c {{0..2}} c"), "t2": ("b {{1..3}} a {{c|d d|}} b",), "t3": ("[[d]] a a",)}
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("abcdX", k=rnd.randint(0, 25)))) for i in range(300)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), names=names, texts=texts).collect():
        n, want = brute_matches(rows[r.doc_id][1], names, texts)
        assert r.n_words == n and {tuple(x) for x in r.found} == want


@pytest.mark.parametrize("bad", ["[[a", "a]]", "{{1..2}} a", "{{a|b", "a | b", "[[a]]"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton({}, {"x": (bad,)})


def test_every_wording_is_accepted_and_mandatory_words_must_all_stand():
    def accepted(words):
        a = licenses.Automaton(licenses.NAMES, licenses.TEXTS)
        return {a.labels[t][1] for t, s, e in a.matches(np.array([a.vocab.get(w.encode(), 0) for w in words])) if a.labels[t][0] == "text"}

    def plain(node, most):
        kind = node[0]
        if kind == "all":
            return [w for x in node[1] for w in plain(x, most)]
        if kind == "word":
            return [node[1]]
        if kind == "gap":
            return ["someone"] * (node[2] if most else node[1])
        return plain(node[1][0 if most else -1], most)

    for label, markups in licenses.TEXTS.items():
        for markup in markups:
            for most in (True, False):
                words = plain(licenses.parse(markup), most)
                assert label in accepted(["x", *words, "y"])
            # without its last mandatory word, or with another one in its midst, nothing is left
            words = plain(licenses.parse(markup), False)
            assert label not in accepted(words[:-1]) or label in ("mit",)
            half = len(words) // 2
            if len(words) > 20:
                assert label not in accepted([*words[:half], "zebra", *words[half:]])


def test_op12(spark, tmp_path):
    notice = "(c) 2020 Jane.\nLicensed under the Apache License, Version 2.0. \nThis work is licensed under the GNU General Public License, version 3.\n"
    rows = [(1, notice * 2), (2, None), (3, ""), (4, "the MIT-License; CC\tBY"), (5, "mit licensed"), (6, "x " * 300_000 + "Licensed under CC BY-NC 4.0."), (6, "gnu gnu general public license"), (None, "Released under the MIT license")]
    rows += [(7, "permission " * 20_000), (8, "Licensed under the Apache License, Version 2.0"), (9, "apache license version 2.0")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    df = licenses.op12_licenses(spark, str(tmp_path))
    assert [dict(df.dtypes)[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")] == ["bigint"] * 5 + ["string"] * 2 + ["double"]
    got = df.collect()
    want = Counter()
    for i, t in rows:
        if t and len(t) > 10_000:
            continue
        n, found = brute_matches(t, licenses.NAMES, licenses.TEXTS)
        base = sorted(s for k, _, s, _ in found if k == "name")
        labels = lambda *kinds: ",".join(sorted({x for k, x, _, _ in found if k in kinds}))  # noqa: E731, B023
        score = 1.0 if labels("text") else 0.5 if base else 0.0
        want[i, n, len(base), base[0] if base else None, base[-1] if base else None, labels("name"), labels("name", "text"), score] += 1
    assert Counter(tuple(r) for r in got if r.n_words < 10_000) == want
    long = {r.n_words: tuple(r)[2:] for r in got if r.n_words > 10_000}
    assert long == {300_007: (1, 300_002, 300_002, "cc-by", "cc-by,cc-by-nc-4.0", 1.0), 20_000: (0, None, None, "", "", 0.0)}
