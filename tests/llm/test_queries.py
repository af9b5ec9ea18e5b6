"""The registered queries over small tables with every hard row, and the stages of the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docloom.llm import bpe, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    rnd = random.Random(30)
    vocab = ["rain", "falls", "on", "the", "quiet", "old", "town", "river", "stone", "bridge", "light", "morning", "Été", "ß"]
    rows = []
    for i in range(60):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(8, 14))) + "." for _ in range(rnd.randint(2, 5))]
        lines.insert(1, "All rights reserved by the owners of this text.")
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}"))
    rows += [(60 + i, "\n".join("BUY!! NOW!! | $$$ " * 3 + str(i) for _ in range(4)), "en", "src1") for i in range(20)]
    rows += [(100, rows[0][1], "en", "src0"), (101, None, None, None), (102, "", "en", "src9"), (103, " \t\n ", "fr", "src0"), (104, "one", "en", "src0"), (104, "one", "en", "src0"), (105, "vile " * 3 + rows[5][1], "en", "src0")]
    rows += [(106, "long words here " * 20_000, "en", "src2"), (107, "<|endoftext|> \U0001f600 x", "en", "src0"), (108, rows[3][1].replace("rain", "snow", 1), "de", "src3")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = make_docs()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < 60), int(i % 9 == 0)) for i in range(80)] + [(None, 1, 1), (9999, 0, 1), (7, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rnd = random.Random(1)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(100)] + [(100, None), (120, [0.0] * 8), (140, [math.nan] * 8), (101, [1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a", "<article><p>Hello &amp; bye</p></article>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def rows_of(spark, folder, n):
    names = [k for k in __spark_entry__.queries() if k.startswith(f"op{n}_")]
    assert len(names) == 1
    df = __spark_entry__.queries()[names[0]](spark, folder)
    return df, df.collect()


def words(text):
    return WORD.findall(text or "")


def held_out(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def types(df, *names):
    return [dict(df.dtypes)[n] for n in names]


def test_op1(spark, folder):
    df, rows = rows_of(spark, folder, 1)
    assert types(df, "doc_id", "held_out", "score", "predicted") == ["bigint", "boolean", "double", "int"]
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in make_docs())
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_op2(spark, folder):
    df, rows = rows_of(spark, folder, 2)
    assert types(df, "doc_id", "size", "source_size", "target", "taken") == ["bigint", "bigint", "bigint", "double", "bigint"]
    docs = make_docs()
    sizes = {}
    for _, t, _, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], len(words(d[1]))) for d in docs)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
        taken[r.source] += r.taken
    least = min(r.size for r in rows if r.size)
    assert all(abs(taken[r.source] - r.target) <= max(least, 60_000 if r.source == "src2" else 30) for r in rows)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in rows_of(spark, folder, 2)[1])


def test_op3(spark, folder):
    df, rows = rows_of(spark, folder, 3)
    assert types(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == ["bigint"] * 6 + ["boolean"] * 2
    texts = dict((d[0], d[1]) for d in make_docs())
    assert len(rows) == len(make_docs())
    for r in rows:
        ws = words(texts[r.doc_id])
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        often = Counter(grams)
        again = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)})
        lines = (texts[r.doc_id] or "").split("\n")
        dups = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
        symbols = sum(c in "#*$%&|<>" for c in texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), symbols, dups, again)
        assert r.base_failed == (len(ws) < 20 or 100 * again > 30 * len(ws)) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    failed = {r.doc_id for r in rows if r.base_failed}
    assert set(range(60)) - failed <= kept and not kept & set(range(60, 80))


def test_op4(spark, folder):
    df, rows = rows_of(spark, folder, 4)
    assert types(df, "doc_id", "fingerprint", "component_id") == ["bigint", "string", "bigint"]
    docs = make_docs()
    fps = [simhash.fingerprint(t or "") for _, t, *_ in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, *_) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((d[0], f"{fp:016x}", least[find(k)]) for k, (d, fp) in enumerate(zip(docs, fps, strict=True)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_op5(spark, folder):
    df, rows = rows_of(spark, folder, 5)
    assert types(df, "query_id", "rank", "vec_id", "score") == ["bigint", "int", "bigint", "double"]
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 100").collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 60, 80]
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True))
    for q, found in got.items():
        best = sorted((i for i in vectors if i != q), key=lambda i: (-dot(q, i), i))[:20]
        assert [i for i, _ in found] == best and [s for _, s in found] == pytest.approx([dot(q, i) for i in best], abs=1e-12)


def test_op6(spark, folder):
    df, rows = rows_of(spark, folder, 6)
    assert types(df, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score") == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*words(lower(t)), ""]
    docs = make_docs()
    count = Counter(w for i, t, *_ in docs if not held_out(i, 7, 2) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    texts = dict((d[0], d[1]) for d in docs)
    assert len(rows) == len(docs)
    for r in rows:
        ts = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(ts), sum(count[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n * 1.0 + v + 1)) for w in ts), rel=1e-9) or r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ts), rel=1e-9)
        assert r.score < 0


def test_op8(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    df, rows = rows_of(spark, folder, 8)
    assert types(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ["bigint", "bigint", "string", "string"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in make_docs():
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_op10(spark, folder):
    df, rows = rows_of(spark, folder, 10)
    assert types(df, "page_id", "url", "text", "n_chars") == ["bigint", "string", "string", "bigint"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == [(1, "Hello & bye", 11), (2, "", 0), (3, "", 0)]


def test_queries_of_empty_tables(spark, empty):
    for n in range(1, 14):
        assert len(rows_of(spark, empty, n)[1]) == (1 if n == 9 else 0)  # the added conversation
    assert corpus_pipeline.run(spark, empty).count() == 0


def odd(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "node", "root", "key", "size", "token", "score", "kept", "n_lines", "line", "rate", "copies", "fp", "h", "u", "v"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES][:-1])
def test_stages_keep_columns_and_hard_rows(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark, make_docs() + [(None, "a row without an id that has words enough to be one of the documents here " * 2, None, None, 3)])
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    known = {(d[0], d[1]) for d in make_docs()}
    if name == "line_dedup":
        assert len(rows) == docs.count() and all(r.n_chars == len(r.text) for r in rows)
        assert sum("All rights reserved" in r.text for r in rows if r.text) == 1
    else:
        assert all((r.doc_id, r.text) in known or r.doc_id is None for r in rows)
    if name == "quality_rules":
        assert {r.doc_id for r in rows} & set(range(60, 80)) == set() and len({r.doc_id for r in rows} & set(range(60))) >= 55
    if name == "simhash_near_dedup":
        ids = Counter(r.doc_id for r in rows)
        assert ids[0] == 1 and ids[100] == 0 and ids[104] == 2 and ids[101] == 1 and ids[102] == ids[103] == 0
    if name == "mixing":
        assert max(Counter(r.doc_id for r in rows).values()) <= 4
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_the_pipeline_runs_stage_after_stage(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    by_hand = Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())
    assert by_hand == Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) and by_hand
    assert types(docs, "doc_id", "ids", "n_tokens") == ["bigint", "array<int>", "bigint"]
