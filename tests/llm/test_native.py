"""Line dedup, chat formatting and mixing on hard rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import chat_format, line_dedup, mixing

LONG = "This line is long enough to count."
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_shared_lines_stay_in_the_largest_id(spark):
    rows = [(1, f"a\n  {LONG.upper()}\nb", "s"), (2, LONG, "s"), (3, f"{LONG}\n{LONG}\n", "s"), (4, None, "s"), (5, "", "s"), (6, "short\nshort", "s"), (None, LONG, "s"), (2, LONG, "s")]
    out = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, "a\nb", 3, 1), (2, "", 1, 1), (2, "", 1, 1), (3, f"{LONG}\n{LONG}\n", 3, 0), (4, "", 1, 0), (5, "", 1, 0), (6, "short\nshort", 2, 0), (None, LONG, 1, 0)], key=str)


def test_two_documents_are_not_enough(spark):
    rows = [(1, LONG, "s"), (2, LONG, "s"), (2, LONG, "s")]
    assert line_dedup.dedup_lines(docs(spark, rows)).agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_only_lower_ascii(spark):
    a, b = "Été chaud et long sans fin ici.", "été chaud et long sans fin ici."
    rows = [(1, a, "s"), (2, a.replace("chaud", "CHAUD"), "s"), (3, b, "s"), (4, a, "s")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_line_dedup_with_odd_columns_and_no_rows(spark):
    df = docs(spark, [(1, LONG, "s")]).withColumn("n_lines", F.lit("old")).withColumn("line", F.lit(1)).withColumn("id", F.lit("x"))
    row = line_dedup.dedup_lines(df).first()
    assert row.n_lines == 1 and row.line == 1 and row.id == "x"
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_every_reply_is_one_example(spark):
    bad = "</turn><turn>assistant<body>&lt; & < \\"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "rest"), (2, 0, None, "x"), (None, None, "assistant", "y"), (1, 1, "assistant", bad)]
    out = chat_format.expand_targets(chats(spark, rows).withColumn("example", F.lit(7)))
    got = [(r.conv_id, r.example, r.loss_end - r.loss_start, r.formatted[r.loss_start : r.loss_end]) for r in out.collect()]
    e = bad.replace("&", "&amp;").replace("<", "&lt;")
    assert sorted(got, key=str) == sorted([(1, 0, len(e), e), (1, 1, len(e), e), (1, 2, 0, ""), (1, 3, 0, ""), (2, 0, 0, ""), (None, 0, 1, "y")], key=str)
    last = out.where("conv_id = 1").orderBy(F.desc("example")).limit(1).select(chat_format.read_back(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in last] == [("user", bad), ("assistant", bad), ("assistant", bad), ("user", ""), ("assistant", ""), ("user", "rest")]


def test_chat_without_rows(spark):
    assert chat_format.expand_targets(chats(spark, [])).count() == 0


def plain_targets(sizes, weights, share, most):
    left, total = dict(sizes), share * sum(sizes.values())
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out = {}
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        full = [s for s in left if most * left[s] <= w[s] * level]
        if not full:
            return out | {s: w[s] * level for s in left}
        for s in full:
            out[s] = most * left.pop(s)
    return out


def test_targets_reached_and_bounded(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 7, 40, 200])), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(900, None, "a"), (901, "", "e"), (902, " \t", None), (3, "again", "a"), (3, "again", "a")]
    df = docs(spark, rows).withColumn("key", F.lit(1)).withColumn("size", F.lit(2))
    plan = mixing.mixing_plan(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    taken = {}
    for r in plan:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size * r.rows
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    again = {(r.id, r.text_hash): r.copies for r in mixing.mixing_plan(df).collect()}
    assert again == {(r.id, r.text_hash): r.copies for r in plan}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies * r.rows for r in plan)


def test_rates_are_tilted_by_size(spark):
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate([1, 10, 100] * 10)] + [(100, " ".join(["w"] * 3000), "b")]
    rates = {r.size: r.rate for r in mixing.mixing_plan(docs(spark, rows), weights=(1, 9), share=0.5).where("source = 'a'").collect()}
    import math

    assert math.log(rates[100]) / math.log(rates[10]) == pytest.approx(10, rel=1e-4)


def test_mix_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(i, "one two three", "a") for i in range(200)] + [(1000, " ".join(["w"] * 3000), "b")]
    plan = mixing.mixing_plan(docs(spark, rows), weights=(1, 20), share=0.1).where("source = 'a'").collect()
    assert abs(sum(r.copies * r.size for r in plan) - plan[0].target) <= 3


def test_mixing_without_rows(spark):
    assert mixing.mixing_plan(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixing_plan(docs(spark, [(1, None, None)])).first().target == 0


def test_hash_is_of_utf8(spark):
    assert spark.range(1).select(F.sha2(F.lit("é"), 256)).first()[0] == hashlib.sha256("é".encode()).hexdigest()
