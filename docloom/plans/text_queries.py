"""Queries of the text and privacy functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy, text
from ..operators import languages
from .suite import query, table

W = r"[\p{L}\p{N}_]+"
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


@query("f01_preprocess", f"""
SELECT doc_id, sha256({collapsed("lower(regexp_replace(regexp_replace(nfc_normalize(text), 'https?://[^ \t\n\r\f\v]+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'))")}) AS digest FROM documents""")
def f01(spark, d):
    t = text.preprocess(F.col("text"), punctuation=True, lowercase=True)
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"))


@query("f02_counts", f"SELECT doc_id, len(regexp_extract_all(text, '{W}')) AS n_words, length(text) AS n_chars FROM documents")
def f02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.char_length("text").cast("long").alias("n_chars"))


@query("f03_tokens", r"""
SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tokens, sha256(array_to_string(regexp_extract_all(text, '\S+')[1:50], ' ')) AS head FROM documents""")
def f03(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"), F.sha2(text.truncate_tokens(F.col("text"), 50), 256).alias("head"))


@query("f04_keywords", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]{{4,}}') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM e WHERE word NOT IN ({_sql_list(text.KEYWORD_STOPS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS keywords FROM r WHERE rank <= 8 GROUP BY doc_id""")
def f04(spark, d):
    return text.keywords(table(spark, d, "documents")).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query("f05_title_description", r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
t AS (SELECT doc_id, ls[1] AS given, array_to_string(ls[1:2], ' ') AS two, len(ls) AS n FROM l)
SELECT doc_id, CASE WHEN length(given) > 160 THEN given[1:157] || '...' ELSE given END AS title,
 CASE WHEN n = 0 THEN NULL WHEN length(two) > 300 THEN two[1:297] || '...' ELSE two END AS description FROM t""")
def f05(spark, d):
    first = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return table(spark, d, "documents").select("doc_id", text.title(first).alias("title"), text.description(F.col("text")).alias("description"))


@query("f06_valid_title", r"""
WITH t AS (SELECT doc_id, source, trim(string_split(text, chr(10))[1]) AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' OR starts_with(lower(s), 'bjbj') OR length(regexp_replace(s, '[^\p{L}\p{N}\s]', '', 'g'))::DOUBLE / length(s) < 0.5
 OR lower(s) = lower(source) THEN NULL ELSE s END AS title FROM t""")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", text.valid_title(F.get(F.split("text", "\n"), F.lit(0)), F.col("source")).alias("title"))


@query("f07_pdf_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def f07(spark, d):
    stamp = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+01'00'"))
    return table(spark, d, "events").select("event_id", text.pdf_date(stamp).alias("day"))


_MARKS = {"en": "the of and to is that it was with for", "fr": "le la les des et est une dans que pour", "de": "der die das und ist nicht ein zu den mit", "es": "el los las que y en una por con del"}
_HITS = ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in m.split())}))), 'code': '{code}'}}" for code, m in _MARKS.items())


@query("f08_language", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(left(text, 5000)), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents), b AS (SELECT doc_id, list_max([{_HITS}]) AS b FROM t)
SELECT doc_id, CASE WHEN b.n > 0 THEN b.code END AS language FROM b""")
def f08(spark, d):
    return table(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query("f08_profiles", f"""WITH t AS (SELECT doc_id, lang, regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, lang, x[i : i + 2] AS gram, count(*) AS k FROM (SELECT doc_id, lang, x, unnest(range(1, length(x) - 1)) AS i FROM t) GROUP BY ALL),
c AS (SELECT lang, gram, sum(k) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
s AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT count(DISTINCT gram) AS v FROM c),
d AS (SELECT doc_id, gram, k FROM g),
l AS (SELECT doc_id, s.lang, sum(k * (ln(coalesce(n, 0) + {languages.PRIOR}) - ln(total + {languages.PRIOR} * v))) AS score FROM d CROSS JOIN s CROSS JOIN v LEFT JOIN c ON c.lang = s.lang AND c.gram = d.gram GROUP BY ALL)
SELECT t.doc_id, arg_max(l.lang, score) AS language FROM t LEFT JOIN l USING (doc_id) GROUP BY ALL""")
def f08_profiles(spark, d):
    """Profiles of all languages of the documents, and the language of each document by them."""
    docs = table(spark, d, "documents")
    return languages.identify(docs, languages.fit(docs)).select("doc_id", "language")


@query("f09_extension", """
SELECT page_id, CASE lower(regexp_extract(url, '\\.([^.]*)$', 1)) WHEN 'yml' THEN 'yaml' ELSE lower(regexp_extract(url, '\\.([^.]*)$', 1)) END AS ext FROM pages""")
def f09(spark, d):
    return table(spark, d, "pages").select("page_id", text.extension(F.col("url")).alias("ext"))


@query("f10_ids", """
SELECT doc_id, sha256(source || ':' || doc_id) AS document_id, sha256(doc_id || ':0:' || text) AS chunk_id FROM documents""")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256_id(F.col("source"), F.col("doc_id")).alias("document_id"), text.sha256_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("f11_previews", """
SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS search, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS cited,
 CASE WHEN length(text) > 500 THEN text[1:500] || '…' ELSE text END AS chunk, text[1:500] AS doc FROM documents""")
def f11(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.shorten(t, 300).alias("search"), text.shorten(t, 200).alias("cited"), text.shorten(t, 500, "…").alias("chunk"), F.left(t, F.lit(500)).alias("doc"))


@query("f12_first_filled", """
SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN role = 'system' THEN ' ' END), ''), nullif(trim(text), ''), role) AS value FROM conversations""")
def f12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.first_filled(F.when(F.col("role") == "system", " "), F.col("text"), F.col("role")).alias("value"))


@query("f19_language_alias", """
SELECT doc_id, CASE lang WHEN 'fr' THEN 'french' WHEN 'en' THEN 'english' END AS plain, CASE lang WHEN 'fr' THEN 'french' WHEN 'en' THEN 'english' END AS regional FROM documents""")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.col("lang")).alias("plain"), text.language(F.concat("lang", F.lit("_BE"))).alias("regional"))


@query("f20_cost", f"""
WITH p(model, a, b) AS (VALUES {", ".join(f"('{m}', {round(100 * a)}, {round(100 * b)})" for m, (a, b) in text.PRICES.items())}),
u AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'mistral-small-latest' ELSE 'own' END AS model, length(text) AS tin, len(regexp_extract_all(text, '\\S+')) AS tout FROM conversations)
SELECT conv_id, turn, round_even((tin * a + tout * b) / 100::DOUBLE, 0) / 1e6 AS cost FROM u LEFT JOIN p ON u.model = p.model""")
def f20(spark, d):
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "mistral-small-latest").otherwise("own")
    return table(spark, d, "conversations").select("conv_id", "turn", text.cost(model, F.char_length("text"), text.token_count(F.col("text"))).alias("cost"))


@query("f21_usage", r"SELECT conv_id, sum(greatest(1, len(regexp_extract_all(text, '\S+'))))::BIGINT AS usage FROM conversations GROUP BY conv_id")
def f21(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(text.usage(F.col("text"))).alias("usage"))


@query("f26_accent_search", """
SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'creation') OR contains(lower(strip_accents(text)), 'etre')""")
def f26(spark, d):
    t = F.lower(text.without_accents(F.col("text")))
    return table(spark, d, "documents").where(t.contains("creation") | t.contains("etre")).select("doc_id")


@query("f27_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f27(spark, d):
    return table(spark, d, "events").select("event_id", text.json_path(F.col("props"), "k").cast("long").alias("k"))


@query("f28_times", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS http FROM events")
def f28(spark, d):
    show = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return table(spark, d, "events").select("event_id", show(text.utc_time(iso)).alias("iso"), show(text.utc_time(http)).alias("http"))


@query("f16_f17_scores", """
SELECT event_id, round(greatest(0, least(1, (value / 100 + 1) / 2)), 6)::DOUBLE AS normalized, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid FROM events""")
def f16(spark, d):
    v = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.round(text.normalized_score(v), 6).alias("normalized"), F.round(text.sigmoid(v), 6).alias("sigmoid"))


_PII_ROWS = "\nUNION ALL ".join(
    f"SELECT doc_id, '{k}' AS pii_type, unnest(regexp_extract_all(text, '(?i){p}')) AS v FROM documents" for k, p in privacy.PATTERNS.items()
)


@query("p01_p02_detect", f"""
WITH r AS ({_PII_ROWS}) SELECT doc_id, pii_type, CASE WHEN length(v) <= 4 THEN '***' ELSE v[1:3] || '***' || right(v, 2) END AS masked FROM r""")
def p01(spark, d):
    return privacy.detect(table(spark, d, "documents"))


def _anonymized(x: str) -> str:
    for p in privacy.PATTERNS.values():
        x = f"regexp_replace({x}, '(?i){p}', '[PII]', 'g')"
    return x


@query("p03_anonymize", f"SELECT doc_id, sha256({_anonymized('text')}) AS digest, len(regexp_extract_all({_anonymized('text')}, '\\[PII\\]')) AS hits FROM documents")
def p03(spark, d):
    t = privacy.anonymize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.regexp_count(t, F.lit(r"\[PII\]")).cast("long").alias("hits"))


_HAS = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in privacy.PATTERNS.values())


@query("p04_exclude", f"SELECT doc_id FROM documents WHERE NOT ({_HAS})")
def p04(spark, d):
    return privacy.apply_action(table(spark, d, "documents"), "exclude").select("doc_id")


@query("p04_warn", f"SELECT doc_id, ({_HAS}) AS has_pii FROM documents")
def p04_warn(spark, d):
    return privacy.apply_action(table(spark, d, "documents"), "warn").select("doc_id", "has_pii")


def _spans_sql() -> str:
    parts = []
    for kind, pattern in privacy.PATTERNS.items():
        p = "'(?i)" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, '{kind}' AS pii_type, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS gaps FROM documents")
    return f"""WITH m AS ({' UNION ALL '.join(parts)}), e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
s AS (SELECT doc_id, pii_type, ms[k] AS v, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : k - 1], lambda x: length(x))), 0) AS pos FROM e)
SELECT doc_id, pii_type, CASE WHEN length(v) <= 4 THEN '***' ELSE v[1:3] || '***' || v[-2:] END AS value, pos::INT AS start, (pos + length(v))::INT AS "end" FROM s"""


@query("p01_spans", _spans_sql())
def p01_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(privacy.detect_spans()(F.col("text"))).alias("m")).select("doc_id", "m.*")
