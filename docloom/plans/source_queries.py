"""Queries of sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.cut import shared_folder
from ..sources import pdf, pdf_export, records, web
from ..streaming import streams
from .monitoring_queries import query_log
from .suite import query, table


@query("s10_sql_source", """SELECT p_partkey::VARCHAR AS id, 'erp' AS source_id, p_name AS title, p_name || ' ' || p_type AS content, sha256(p_name || ' ' || p_type) AS content_hash FROM part""")
def s10(spark, d):
    table(spark, d, "part").createOrReplaceTempView("docloom_part")
    return records.from_query(spark, "SELECT p_partkey, p_name, concat(p_name, ' ', p_type) AS body FROM docloom_part", "erp", "p_partkey", "body", "p_name")


@query("s11_json_items", """SELECT event_id::VARCHAR AS id, 'api' AS source_id, event_id::VARCHAR AS title, json_extract_string(props, '$.k') AS content, sha256(json_extract_string(props, '$.k')) AS content_hash FROM events""")
def s11(spark, d):
    body = F.concat(F.lit('{"data":{"rows":[{"key":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}]}}"))
    return records.from_json_items(table(spark, d, "events").select(body.alias("body")), "api", "data.rows", "key", "props.k")


@query("s19_strip_html", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def s19(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(web.stripped(F.col("html")), 256).alias("digest"))


@query("s20_dom_text")
def s20(spark, d):
    return table(spark, d, "pages").select("page_id", web.page_parts(F.col("html")).alias("p")).select("page_id", "p.*")


@query("s21_hrefs", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
def s21(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(web.hrefs(F.col("html"))).alias("href"))


@query("s21_links", r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS host, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, CASE WHEN href LIKE 'http%' THEN href ELSE host || href END AS link FROM h""")
def s21_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(web.links(F.col("url"), F.col("html"))).alias("link"))


@query("s03_crawl", r"""WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
n AS (SELECT host, 'http://' || host || '/' || page_id AS url, lead('http://' || host || '/' || page_id, 1) OVER w AS one, lead('http://' || host || '/' || page_id, 3) OVER w AS three, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id)),
l AS (SELECT url AS base, one AS url FROM n WHERE one NOT LIKE '%7' UNION ALL SELECT url, three FROM n WHERE three NOT LIKE '%7'),
c AS (SELECT url, 0 AS depth FROM n WHERE i = 1 UNION SELECT l.url, c.depth + 1 FROM c JOIN l ON l.base = c.url WHERE c.depth < 3)
SELECT url, min(depth)::INT AS depth FROM c GROUP BY 1""")
def s03(spark, d):
    """A network over the hosts of the pages, each page linked to the next and the third after it; from the first of every host, addresses that end in 7 are not entered."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    own = F.concat(F.lit("http://"), F.col("host"), F.lit("/"), F.col("page_id"))
    along = Window.partitionBy("host").orderBy("page_id")
    pages = table(spark, d, "pages").select("page_id", host.alias("host")).withColumn("url", own)
    tags = [F.concat(F.lit('<p><a href="'), F.lead("url", k).over(along), F.lit(f'#part{k}">next</a></p>')) for k in (1, 3)]
    pages = pages.select("url", F.concat_ws("", *tags).alias("html"), F.row_number().over(along).alias("i"))
    return web.crawl(pages.select("url", "html"), pages.where("i = 1").select("url"), depth=3, exclude=("*7",))


@query("g10_source_stats", """SELECT source AS ext, count(*) AS files, round_even(sum(n_chars) / 1048576.0::DOUBLE, 2) AS size_mb, FALSE AS supported FROM documents GROUP BY 1""")
def g10(spark, d):
    from ..sources.files import folder_stats

    return folder_stats(table(spark, d, "documents").select(F.col("source").alias("ext"), F.col("n_chars").alias("size")))


@query("g11_folder_tree", """WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS parts, length(html) AS size FROM pages),
l AS (SELECT parts[1:len(parts) - 1] AS f, size FROM p), e AS (SELECT f, size, unnest(range(0, least(len(f), 3) + 1)) AS depth FROM l)
SELECT array_to_string(f[1:depth], '/') AS folder, depth::INT AS depth, count(*) AS files, sum(size)::BIGINT AS size FROM e GROUP BY ALL""")
def g11(spark, d):
    from ..sources.files import folder_tree

    return folder_tree(table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("rel"), F.char_length("html").cast("long").alias("size")))


@query("w08_streamed_activity", """SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS rag FROM events GROUP BY 1""")
def w08(spark, d):
    """The stream run to its end; the memory sink holds one row a day."""
    kind = table(spark, d, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    log = stream.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "question").when(F.col("event_type") == "click", "clarification").otherwise("other").alias("intent"))
    name = f"docloom_activity_{uuid.uuid4().hex}"
    run = streams.daily_activity(log, "60 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_folder(spark, "activity")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).withColumn("day", F.col("day").cast("string"))


@query("w01_signature", """WITH h AS (SELECT sha256(event_type || ':' || event_id) AS h FROM events WHERE event_type = 'error')
SELECT count(*) || '-' || sum(('0x' || h[1:15])::HUGEINT) || '-' || sum(('0x' || h[16:30])::HUGEINT) AS signature FROM h""")
def w01(spark, d):
    rows = query_log(spark, d).where("answer = 'error'").select(F.col("answer").alias("change_type"), F.col("id").cast("string").alias("path"))
    return streams.signature(rows)


@query("s16_pdf", """SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) AS digest, ((len(string_split(text, chr(10))) + 49) // 50)::INT AS pages FROM documents""")
def s16(spark, d):
    """Every document is written as a PDF file of 50 lines a page and read back; empty lines show nothing in it."""
    files = table(spark, d, "documents").select("doc_id", pdf.contents(pdf_export.pdf_of("text")).alias("c"))
    return files.select("doc_id", F.sha2(F.array_join(F.filter(F.split("c.text", "\n"), lambda x: x != ""), "\n"), 256).alias("digest"), "c.pages")
