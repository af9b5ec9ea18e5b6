"""Text, privacy and chunk functions against literal figures."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as ch
from docloom.functions import privacy, text
from docloom.operators import chunks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_sentences(spark):
    assert one(spark, "A b. C d!  E?f", ch.sentences) == ["A b.", "C d!", "E?f"]
    assert one(spark, "  ", ch.sentences) == []


def test_windows(spark):
    words = [f"w{i}" for i in range(1, 11)]
    assert one(spark, " ".join(words), lambda x: ch.windows(x, 5, 2)) == ["w1 w2 w3 w4 w5", "w4 w5 w6 w7 w8", "w7 w8 w9 w10", "w10"]


def test_paragraphs_pass_a_large_one_ahead(spark):
    c = ch.ChunkConfig("paragraph_based", chunk_size=4, chunk_overlap=0, min_chunk_size=1, max_chunk_size=4)
    got = one(spark, "a b\n\nc d. e f. g h.\n\ni j", lambda x: ch.by_paragraph(x, c))
    assert got == ["c d. e f.", "g h.", "a b\n\ni j"]


def test_recursive_and_headers(spark):
    c = ch.ChunkConfig("recursive", chunk_size=3, chunk_overlap=0, min_chunk_size=1, max_chunk_size=3)
    assert one(spark, "a b\n\nc d e f. g h", lambda x: ch.recursive(x, c)) == ["a b", "c", "d", "e", "f", "g h"]
    h = ch.ChunkConfig("markdown_header", chunk_size=100, chunk_overlap=0, min_chunk_size=1, header_levels=(1, 2))
    assert one(spark, "intro\n# A\ntext\n### deep\n## B\nmore", lambda x: ch.by_header(x, h)) == ["intro", "# A\ntext\n### deep", "## B\nmore"]


def test_overlap_and_merge(spark):
    c = ch.ChunkConfig("sentence_based", chunk_size=4, chunk_overlap=2, min_chunk_size=1, max_chunk_size=9)
    got = one(spark, "a b. c d. e f. g h.", lambda x: ch.chunk(x, c))
    assert [g.content for g in got] == ["a b. c d.", "c d. e f. g h."]
    small = ch.ChunkConfig("sentence_based", chunk_size=4, chunk_overlap=0, min_chunk_size=3, max_chunk_size=9)
    assert [g.tokens for g in one(spark, "a b. c d. e f.", lambda x: ch.chunk(x, small))] == [6]
    assert one(spark, None, lambda x: ch.chunk(x, small)) == []


def test_config_bounds():
    for bad in ({"chunk_overlap": 600}, {"min_chunk_size": 600}, {"max_chunk_size": 10}, {"header_levels": (7,)}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            ch.ChunkConfig(**bad)
    assert ch.ChunkConfig(header_levels=(2, 1, 2)).header_levels == (1, 2)
    assert ch.ChunkConfig(chunk_overlap=300).warnings()


def test_distribution(spark):
    rows = spark.createDataFrame([(n,) for n in (10, 49, 50, 120)], "tokens long").withColumn("overlap_before_tokens", F.lit(0))
    assert [r["count"] for r in chunks.distribution(rows).orderBy("range_start").collect()] == [2, 1, 1]
    s = chunks.stats(rows).first()
    assert (s.median_size_tokens, s.avg_size_tokens) == (49.5, 57.25)


@pytest.mark.parametrize(
    ("value", "kinds", "after"),
    [
        ("Contact: jean.dupont@email.com for info", [("email", 9, 30)], "Contact: [PII] for info"),
        ("Appelez-nous au 01 23 45 67 89", [("phone", 16, 30)], "Appelez-nous au [PII]"),
        ("tel +33 6 12 34 56 78", [], "tel +33 6 12 34 56 78"),
        ("Card: 4111 1111 1111 1111", [("credit_card", 6, 25)], "Card: [PII]"),
        ("IBAN: FR76 3000 6000 0112 3456 7890 189", [("credit_card", 11, 30), ("iban", 6, 39)], "IBAN: FR76 [PII] 7890 189"),
        ("Habite au 42 rue de la paix", [("address", 10, 16)], "Habite au [PII] de la paix"),
        ("1 85 05 78 006 084 36", [("ssn", 0, 21)], "[PII]"),
        ("nothing here", [], "nothing here"),
    ],
)
def test_privacy(spark, value, kinds, after):
    assert [(m.pii_type, m.start, m.end) for m in one(spark, value, privacy.detect_spans())] == kinds
    assert one(spark, value, privacy.anonymize) == after
    assert one(spark, after, privacy.anonymize) == after


def test_small_functions(spark):
    assert one(spark, "abc", text.mask) == "***" and one(spark, "jean@test.com", text.mask) == "jea***om"
    assert one(spark, "D:20240131120000+01'00'", text.pdf_date) == "2024-01-31"
    assert one(spark, "fr_BE", text.language) == "french" and one(spark, "de", text.language) is None
    assert one(spark, "  \n a\n\nb\nc", text.description) == "a b"
    assert one(spark, "bjbj x", lambda x: text.valid_title(x, F.lit("f"))) is None
    assert one(spark, "Été", text.without_accents) == "Ete"
    assert one(spark, "le chat et la souris dans une maison", text.detect_language) == "fr"
