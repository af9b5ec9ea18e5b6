"""Highlights and phrases from positions against regular expressions over the texts."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import lexical, positions, stores


def test_highlights_equal_those_of_texts(spark):
    rnd = random.Random(2)
    words = ["Alpha", "alphabet", "beta", "Été", "gamma_2", "x", "\U0001f600", "a"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(q, i, t) for q, t in enumerate([["alpha"], ["a", "alpha"], ["alpha", "a", " "], ["été", "gamma"], [], ["nowhere", "X"]]) for i in range(0, 103, 3)]
    asked = spark.createDataFrame(asked, "query_id int, id long, terms array<string>")
    got = positions.highlights(positions.positions(docs), asked).collect()
    old = asked.join(docs.withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", F.explode(lexical.highlights("text", "terms")).alias("h")).select("query_id", "id", "h.*").collect()
    lower = lambda r: (r.query_id, r.id, r.start, r.end, r.term.lower())
    assert sorted(map(lower, got)) == sorted(map(lower, old)) and len(got) > 300


def test_phrases_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("a b A c".split(), k=rnd.randint(0, 30)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(1, ["a", "b"]), (2, ["A", "a", "c"]), (3, []), (4, ["b"]), (5, ["a", "zzz"]), (6, ["a", "a"])]
    got = positions.phrases(positions.positions(docs), spark.createDataFrame(asked, "query_id int, words array<string>")).collect()
    want = set()
    for i, text in rows:
        ms = list(re.finditer(r"\w+", text))
        for q, ws in asked:
            for k in range(len(ms) - len(ws) + 1 if ws else 0):
                if [m[0].lower() for m in ms[k : k + len(ws)]] == [w.lower() for w in ws]:
                    want.add((q, i, k, ms[k].start(), ms[k + len(ws) - 1].end()))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_reader_finds_a_version_at_any_moment(spark, tmp_path):
    path = str(tmp_path)
    assert stores.current(spark, path) is None
    rows = spark.range(3)
    assert [stores.commit(rows, path), stores.commit(rows.limit(1), path)] == ["v1", "v2"]
    stores.point(spark, path, "v1")
    assert stores.current(spark, path) == "v1" and stores.load(spark, path).count() == 3
    assert stores.commit(rows.limit(2), path) == "v3" and stores.load(spark, path).count() == 2
    assert len(list((tmp_path / "current").glob("0*"))) == 4  # none was written over


def test_places_are_opened_by_the_rarest_word(spark, monkeypatch):
    rows = [(i, "the the the the cat" if i == 7 else "the dog the dog the dog") for i in range(50)]
    index = positions.positions(spark.createDataFrame(rows, "doc_id long, text string"), only={"the", "cat"})
    assert {r.term for r in index.select("term").distinct().collect()} == {"the", "cat"}
    opened, plain = [], positions._places
    monkeypatch.setattr(positions, "_places", lambda rows: opened.append(plain(rows)) or opened[-1])
    got = positions.phrases(index, spark.createDataFrame([(1, ["the", "cat"]), (2, ["the", "bird"])], "query_id int, words array<string>"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 3, 12, 19)]
    places = [x.where("query_id = 1").count() for x in opened]
    assert sum(places) == 5  # the cat and four words before it, none of the other 147
