"""Queries of the chunkers over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as ch
from ..operators import chunks
from .suite import query, table

SENTENCES = r"""
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, (' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, (' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM s),
t AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '\S+')) AS n, list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')) AS ws FROM e)"""


def _packed(size: int) -> str:
    return f"""RECURSIVE {SENTENCES.strip()},
g AS (SELECT doc_id, i, x, n, n AS have, 0 AS grp FROM t WHERE i = 1
 UNION ALL SELECT t.doc_id, t.i, t.x, t.n, CASE WHEN g.have + t.n > {size} THEN t.n ELSE g.have + t.n END, CASE WHEN g.have + t.n > {size} THEN g.grp + 1 ELSE g.grp END
 FROM g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i + 1),
c AS (SELECT doc_id, grp AS chunk_index, string_agg(x, ' ' ORDER BY i) AS content, sum(n)::BIGINT AS tokens FROM g GROUP BY doc_id, grp)"""


_PLAIN = dict(chunk_overlap=0, min_chunk_size=1)


def _digest(df):
    return df.select("doc_id", "chunk_index", F.sha2("content", 256).alias("digest"), "tokens")


@query("c01_sentences", f"WITH {SENTENCES} SELECT doc_id, i::INT - 1 AS place, sha256(x) AS digest FROM t")
def c01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(ch.sentences(F.col("text"))).alias("place", "x")).select("doc_id", "place", F.sha2("x", 256).alias("digest"))


@query("c02_sentence_chunks", f"WITH {_packed(128)} SELECT doc_id, chunk_index::INT AS chunk_index, sha256(content) AS digest, tokens FROM c")
def c02(spark, d):
    return _digest(chunks.chunk_documents(table(spark, d, "documents"), ch.ChunkConfig("sentence_based", chunk_size=128, **_PLAIN)))


@query("c03_fixed_sentences", f"WITH {_packed(64)} SELECT doc_id, chunk_index::INT AS chunk_index, sha256(content) AS digest, tokens FROM c")
def c03(spark, d):
    return _digest(chunks.chunk_documents(table(spark, d, "documents"), ch.ChunkConfig("fixed_size", chunk_size=64, **_PLAIN)))


_WINDOWS = r"""w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(0, len(ws), 48)) AS a FROM w),
c AS (SELECT doc_id, (a // 48)::INT AS chunk_index, array_to_string(ws[a + 1 : a + 64], ' ') AS content, least(64, len(ws) - a) AS tokens FROM k)"""


@query("c04_windows", f"WITH {_WINDOWS} SELECT doc_id, chunk_index, sha256(content) AS digest FROM c")
def c04(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(ch.windows(F.col("text"), 64, 16)).alias("chunk_index", "content"))
    return out.select("doc_id", "chunk_index", F.sha2("content", 256).alias("digest"))


_TRIM = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PARAGRAPHS = rf"""RECURSIVE pa AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS ps FROM documents),
pe AS (SELECT doc_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i FROM pa),
pn AS (SELECT *, len(regexp_extract_all(x, '\S+')) AS n FROM pe),
-- paragraphs within the maximum are packed in their order
small AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM pn WHERE n <= 256),
g AS (SELECT doc_id, k, i, x, n, n AS have, i AS grp FROM small WHERE k = 1
 UNION ALL SELECT s.doc_id, s.k, s.i, s.x, s.n, CASE WHEN g.have + s.n > 128 THEN s.n ELSE g.have + s.n END, CASE WHEN g.have + s.n > 128 THEN s.i ELSE g.grp END FROM g JOIN small s ON s.doc_id = g.doc_id AND s.k = g.k + 1),
packed AS (SELECT doc_id, grp, string_agg(x, chr(10) || chr(10) ORDER BY i) AS content, sum(n)::BIGINT AS tokens FROM g GROUP BY doc_id, grp),
-- larger ones are cut into sentences, which are packed
ls AS (SELECT doc_id, i, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, {_TRIM})), lambda y: y <> '') AS ss FROM pn WHERE n > 256),
le AS (SELECT doc_id, i, unnest(ss) AS y, unnest(range(1, len(ss) + 1)) AS k FROM ls),
ln AS (SELECT *, len(regexp_extract_all(y, '\S+')) AS n FROM le),
h AS (SELECT doc_id, i, k, y, n, n AS have, 0 AS grp FROM ln WHERE k = 1
 UNION ALL SELECT l.doc_id, l.i, l.k, l.y, l.n, CASE WHEN h.have + l.n > 128 THEN l.n ELSE h.have + l.n END, CASE WHEN h.have + l.n > 128 THEN h.grp + 1 ELSE h.grp END FROM h JOIN ln l ON l.doc_id = h.doc_id AND l.i = h.i AND l.k = h.k + 1),
cut AS (SELECT doc_id, i, grp, string_agg(y, ' ' ORDER BY k) AS content, sum(n)::BIGINT AS tokens FROM h GROUP BY doc_id, i, grp),
-- what is packed comes where the paragraph stands that found no room, or last
every AS (SELECT doc_id, coalesce(lead(grp) OVER (PARTITION BY doc_id ORDER BY grp), 1000000000) AS pos, 0 AS sub, content, tokens FROM packed UNION ALL SELECT doc_id, i, grp, content, tokens FROM cut)"""


@query("c05_paragraph_chunks", f"WITH {_PARAGRAPHS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1)::INT AS chunk_index, sha256(content) AS digest, tokens FROM every")
def c05(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return _digest(chunks.chunk_documents(docs, ch.ChunkConfig("paragraph_based", chunk_size=128, max_chunk_size=256, **_PLAIN)))


@query("c06_semantic_chunks", f"""WITH RECURSIVE {SENTENCES.strip()},
a AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM t),
j AS (SELECT *, CASE WHEN len(pw) + len(ws) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(pw, ws))::DOUBLE / (len(pw) + len(ws) - len(list_intersect(pw, ws))) END AS sim FROM a),
g AS (SELECT doc_id, i, x, n AS have, 0 AS grp FROM j WHERE i = 1
 UNION ALL SELECT j.doc_id, j.i, j.x, CASE WHEN sim < 0.1::DOUBLE OR g.have + j.n > 200 THEN j.n ELSE g.have + j.n END, CASE WHEN sim < 0.1::DOUBLE OR g.have + j.n > 200 THEN g.grp + 1 ELSE g.grp END
 FROM g JOIN j ON j.doc_id = g.doc_id AND j.i = g.i + 1)
SELECT doc_id, grp::INT AS chunk_index, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM g GROUP BY doc_id, grp""")
def c06(spark, d):
    c = ch.ChunkConfig("semantic", chunk_size=100, max_chunk_size=200, similarity_threshold=0.1, **_PLAIN)
    return _digest(chunks.chunk_documents(table(spark, d, "documents"), c)).drop("tokens")


def _recursive(size: int) -> str:
    """Pieces over ``size`` cut at each separator in turn, with the places that they come from."""
    parts, keys = ["v0 AS (SELECT doc_id, text AS x FROM documents)"], "doc_id"
    for k, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "'. '", "' '")):
        cut = f"CASE WHEN len(regexp_extract_all(x, '\\S+')) <= {size} THEN [x] WHEN len(sp) = 1 THEN sp ELSE list_filter(list_transform(sp, lambda y: trim(y, {_TRIM})), lambda y: y <> '') END"
        parts.append(f"v{k + 1} AS (SELECT {keys}, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i{k} FROM (SELECT *, {cut} AS ps FROM (SELECT *, string_split(x, {sep}) AS sp FROM v{k})))")
        keys += f", i{k}"
    return ",\n".join(parts) + f", ve AS (SELECT {keys}, trim(x, {_TRIM}) AS x FROM v4)"


@query("c07_recursive_chunks", f"WITH {_recursive(128)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i0, i1, i2, i3) - 1)::INT AS chunk_index, sha256(x) AS digest, len(regexp_extract_all(x, '\\S+'))::BIGINT AS tokens FROM ve WHERE x <> ''")
def c07(spark, d):
    return _digest(chunks.chunk_documents(table(spark, d, "documents"), ch.ChunkConfig("recursive", chunk_size=128, **_PLAIN)))


@query("c08_header_chunks")
def c08(spark, d):
    from ..sources.web import markdown

    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), markdown(F.col("html")).alias("text"))
    return _digest(chunks.chunk_documents(pages, ch.ChunkConfig("markdown_header", chunk_size=128, **_PLAIN)))


_OVER = f"""o AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM c),
v AS (SELECT *, array_to_string(regexp_extract_all(prev, '\\S+')[-10:], ' ') AS ov FROM o)"""


@query("c09_overlap", f"""WITH {_WINDOWS}, {_OVER}
SELECT doc_id, chunk_index, sha256(CASE WHEN prev IS NULL OR starts_with(content, ov) THEN content ELSE ov || ' ' || content END) AS digest FROM v""")
def c09(spark, d):
    c = ch.ChunkConfig("fixed_size", chunk_size=64, chunk_overlap=10, min_chunk_size=1, preserve_sentences=False)
    over = ch.overlapped(ch.windows(F.col("text"), 64, 16), c)
    return table(spark, d, "documents").select("doc_id", F.posexplode(over).alias("chunk_index", "x")).select("doc_id", "chunk_index", F.sha2("x", 256).alias("digest"))


@query("c10_min_merge", f"""WITH RECURSIVE {_WINDOWS},
g AS (SELECT doc_id, chunk_index, content, 0 AS grp FROM c WHERE chunk_index = 0
 UNION ALL SELECT c.doc_id, c.chunk_index, c.content, CASE WHEN c.tokens < 40 THEN g.grp ELSE g.grp + 1 END FROM g JOIN c ON c.doc_id = g.doc_id AND c.chunk_index = g.chunk_index + 1)
SELECT doc_id, grp::INT AS chunk_index, sha256(string_agg(content, ' ' ORDER BY chunk_index)) AS digest FROM g GROUP BY doc_id, grp""")
def c10(spark, d):
    c = ch.ChunkConfig("fixed_size", chunk_size=64, chunk_overlap=0, min_chunk_size=40)
    out = table(spark, d, "documents").select("doc_id", F.posexplode(ch.merged(ch.windows(F.col("text"), 64, 16), c)).alias("chunk_index", "x"))
    return out.select("doc_id", "chunk_index", F.sha2("x", 256).alias("digest"))


_PREVIEW = f"""{_WINDOWS}, p AS (SELECT *, lag(content) OVER w AS prev, lead(content) OVER w AS next FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
q AS (SELECT *, array_to_string(regexp_extract_all(prev, '\\S+')[-16:], ' ') AS b, array_to_string(regexp_extract_all(content, '\\S+')[-16:], ' ') AS f FROM p),
r AS (SELECT doc_id, chunk_index, content, tokens, CASE WHEN contains(content, b) THEN len(regexp_extract_all(b, '\\S+')) ELSE 0 END AS overlap_before_tokens,
 CASE WHEN contains(next, f) THEN len(regexp_extract_all(f, '\\S+')) ELSE 0 END AS overlap_after_tokens FROM q)"""


def _windowed(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(ch.windows(F.col("text"), 64, 16)).alias("chunk_index", "content"))
    return chunks.preview(out.withColumn("tokens", ch.token_count(F.col("content"))), ch.ChunkConfig("fixed_size", chunk_size=64, chunk_overlap=16))


@query("c13_preview", f"WITH {_PREVIEW} SELECT doc_id, chunk_index, overlap_before_tokens::BIGINT AS overlap_before_tokens, overlap_after_tokens::BIGINT AS overlap_after_tokens FROM r")
def c13(spark, d):
    return _windowed(spark, d).select("doc_id", "chunk_index", "overlap_before_tokens", "overlap_after_tokens")


@query("c14_stats", f"""WITH {_PREVIEW} SELECT count(*) AS total_chunks, round_even(avg(tokens), 2) AS avg_size_tokens, min(tokens)::BIGINT AS min_size_tokens, max(tokens)::BIGINT AS max_size_tokens,
 median(tokens) AS median_size_tokens, sum(overlap_before_tokens)::BIGINT AS total_overlap_tokens, count(*) > 200 AS many FROM r""")
def c14(spark, d):
    return chunks.stats(_windowed(spark, d))


@query("c14_distribution", f"""WITH {_packed(512)}, b AS (SELECT tokens // 50 AS k, count(*) AS n FROM c GROUP BY 1), sp AS (SELECT unnest(range(0, (SELECT max(k) + 1 FROM b))) AS k)
SELECT sp.k * 50 AS range_start, (sp.k + 1) * 50 AS range_end, coalesce(n, 0) AS count FROM sp LEFT JOIN b ON sp.k = b.k""")
def c14b(spark, d):
    return chunks.distribution(chunks.chunk_documents(table(spark, d, "documents"), ch.ChunkConfig("sentence_based", **_PLAIN)))


@query("c10_pipeline")
def c10_pipeline(spark, d):
    """The default chunker: sentences, overlap, merge."""
    return _digest(chunks.chunk_documents(table(spark, d, "documents"), ch.ChunkConfig()))
