"""Language profiles: exact scores, held-out accuracy, and what texts without a language get."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import detect_language
from docloom.operators import languages

DATA = "/root/testdata/sf0.01/documents.parquet"
TEXTS = [("en", "the cat sat on the mat and the dog ran"), ("en", "this is the house that the man built"), ("fr", "le chat est sur la table et le chien court"), ("fr", "c'est la maison que l'homme a construite"), ("ru", "кошка сидит на столе"), (None, "zzz"), ("xx", None), ("en", "")]


def plain(text):
    return re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")


def test_scores_equal_sums_over_grams(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(TEXTS)], "doc_id int, text string, lang string")
    found = languages.fit(docs)
    counts, grams = {}, lambda t: [plain(t)[i : i + 3] for i in range(len(plain(t)) - 2)]
    for lang, t in TEXTS:
        if lang and grams(t):
            counts.setdefault(lang, Counter()).update(grams(t))
    assert found.langs == sorted(counts)
    v = len(set().union(*counts.values()))
    asked = ["the man", "le chien", "кошка", "q\U0001f600x the", "12 34"]
    scores, n = found.scores([plain(t) for t in asked])
    for t, row, k in zip(asked, scores, n, strict=True):
        assert k == len(grams(t))
        assert list(row) == pytest.approx([sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * v)) for g in grams(t)) for x in found.langs])
    rows = spark.createDataFrame(list(enumerate([*asked, None, ""])), "doc_id int, text string")
    got = {r.doc_id: (r.language, r.margin) for r in languages.identify(rows, found).collect()}
    assert [got[i][0] for i in range(7)] == ["en", "fr", "ru", "en", None, None, None] and got[5][1] is None and got[0][1] > 0
    assert {r.language for r in languages.identify(rows, languages.fit(docs.limit(0))).collect()} == {None}


def test_a_mixed_text_has_a_small_margin_and_the_larger_part_decides(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(TEXTS)], "doc_id int, text string, lang string")
    rows = spark.createDataFrame([(0, "the house on the mat"), (1, "the house on the mat la table est sur la maison que le chien"), (2, "the cat and the dog and the man la table")], "doc_id int, text string")
    got = {r.doc_id: r for r in languages.identify(rows, languages.fit(docs)).collect()}
    assert got[0].language == "en" and got[1].language == "fr" and got[2].language == "en" and got[1].margin < got[0].margin


def test_parts_of_a_batch_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(DATA).limit(60)
    whole = languages.identify(docs, languages.fit(docs)).collect()
    monkeypatch.setattr(languages, "HELD", 3000)
    assert {(r.doc_id, r.language, round(r.margin, 9)) for r in languages.identify(docs, languages.fit(docs)).collect()} == {(r.doc_id, r.language, round(r.margin, 9)) for r in whole}


def test_held_out_accuracy_is_above_the_rule_of_stop_words(spark):
    docs = spark.read.parquet(DATA).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 1)
    # short pieces, for whole documents are too easy for either
    pieces = docs.where("held").withColumn("text", F.substring("text", 1, 60))
    found = languages.identify(pieces, languages.fit(docs.where("not held")))
    right = pieces.join(found, "doc_id").withColumn("rule", detect_language(F.col("text"))).agg(F.avg((F.col("language") == F.col("lang")).cast("double")).alias("ours"), F.avg(F.coalesce(F.col("rule") == F.col("lang"), F.lit(False)).cast("double")).alias("rule")).first()
    print(right)
    assert right.ours > 0.97 and right.ours >= right.rule
