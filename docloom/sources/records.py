"""Rows of queries, feeds and interfaces as document rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import count
from xml.etree import ElementTree

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import json_path, utc_time

DOCUMENT = "id string, source_id string, title string, content string, last_modified string, content_hash string"


def from_query(spark: SparkSession, query: str, source_id: str, id_column: str, content_column: str, title_column: str | None = None, max_rows: int | None = None) -> DataFrame:
    """The rows of one SELECT as documents; rows without an id go, a missing title is "Row <id>".

    The query is parsed, not searched for words: what is not a single query fails before it runs.
    """
    if not re.match(r"(?is)\s*(select|with)\b", query):
        raise ValueError("only a SELECT is allowed")
    try:
        rows = spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)")  # a statement that changes something cannot stand here
    except ParseException as e:
        raise ValueError("only a SELECT is allowed") from e
    rows = rows.where(F.col(id_column).isNotNull())
    rows = rows.limit(max_rows) if max_rows else rows
    i, text = F.col(id_column).cast("string"), F.coalesce(F.col(content_column).cast("string"), F.lit(""))
    name = F.coalesce(F.col(title_column).cast("string") if title_column else F.lit(None), F.concat(F.lit("Row "), i))
    return rows.select(i.alias("id"), F.lit(source_id).alias("source_id"), name.alias("title"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))


def from_json_items(pages: DataFrame, source_id: str, items: str, id_path: str, content_path: str, title_path: str | None = None) -> DataFrame:
    """Documents of the items at a JSON path of answer texts (body)."""
    each = pages.select(F.explode(F.from_json(json_path(F.col("body"), items), "array<string>")).alias("item"))
    text = F.coalesce(json_path(F.col("item"), content_path), F.lit(""))
    i = json_path(F.col("item"), id_path)
    return each.select(i.alias("id"), F.lit(source_id).alias("source_id"), F.coalesce(json_path(F.col("item"), title_path) if title_path else F.lit(None), i).alias("title"), text.alias("content"), F.sha2(text, 256).alias("content_hash")).where("id is not null")


def next_page(kind: str, number: int, size: int, answer: dict | None = None, cursor_path: str = "next") -> dict | None:
    """Parameters of page ``number`` (from 0) of an interface that pages by none, offset, page or cursor; None behind the last."""
    if kind == "none":
        return {} if number == 0 else None
    if kind == "offset":
        return {"offset": number * size, "limit": size}
    if kind == "page":
        return {"page": number + 1, "per_page": size}
    if kind == "cursor":
        if number == 0:
            return {"limit": size}
        at: object = answer or {}
        for key in cursor_path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        return {"cursor": at, "limit": size} if at else None
    raise ValueError(f"unknown paging: {kind}")


def rest_pages(fetch: Callable[[dict], dict], kind: str = "none", size: int = 100, items: str = "items", most: int | None = None, cursor_path: str = "next") -> Iterator[dict]:
    """The answers of ``fetch`` page by page until one has no items, is short, or has no cursor; more than ``most`` pages, if given, are an error."""
    answer: dict | None = None
    for number in count():
        if most is not None and number >= most:
            raise ValueError(f"more than {most} pages")
        asked = next_page(kind, number, size, answer, cursor_path)
        if asked is None:
            return
        answer = fetch(asked)
        got = answer.get(items) or []
        if got:
            yield answer
        if not got or kind in ("offset", "page") and len(got) < size:
            return


def feed_entries(xml: str, most: int = 100) -> list[dict]:
    """The first entries of an RSS or Atom feed; an entry's id is its id, else guid, link or title."""
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for e in ElementTree.fromstring(xml).iter():
        if local(e) not in ("item", "entry"):
            continue
        f = {local(c): (c.text or c.get("href") or "").strip() for c in e}
        key = next((f[k] for k in ("id", "guid", "link", "title") if f.get(k)), None)
        if key:
            out.append({"id": key, "title": f.get("title", ""), "content": f.get("content") or f.get("description") or f.get("summary") or "", "published": f.get("published") or f.get("pubDate") or f.get("updated") or ""})
    return out[:most]


def recent(entries: DataFrame, now: str, days: int) -> DataFrame:
    """The entries (published) of the last ``days`` days; those without a date stay."""
    at = utc_time(F.col("published"))
    return entries.where(at.isNull() | (at >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))


def notion_text(blocks: list[dict]) -> str:
    """Blocks of a page as markdown."""
    marks = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "to_do": "- [ ] "}
    out = []
    for b in blocks:
        kind = b.get("type", "")
        text = "".join(t.get("plain_text", "") for t in (b.get(kind) or {}).get("rich_text", []))
        if kind == "code":
            out.append(f"```\n{text}\n```")
        elif text:
            out.append(marks.get(kind, "") + text)
    return "\n\n".join(out)


class _Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class _TreeReader(DataSourceReader):
    """Reads a listing that is a tree of folders, one folder a partition."""

    def __init__(self, options: dict):
        self.tree, self.source = json.loads(options["tree"]), options.get("source_id", "drive")

    def partitions(self):
        return [_Part(f) for f in sorted(self.tree)] or [_Part("")]

    def read(self, partition):
        for item in self.tree.get(partition.folder, []):
            yield (f"{self.source}:{item['id']}", self.source, item.get("name", ""), item.get("content", ""), item.get("modified"), item.get("hash") or f"{item['id']}:{item.get('modified')}")


class TreeSource(DataSource):
    """Python data source for drives and buckets: option ``tree`` holds the folders of a client's listing.

    Clients of real services list into this form; the stub that tests use is a literal.
    """

    @classmethod
    def name(cls):
        return "docloom_tree"

    def schema(self):
        return DOCUMENT

    def reader(self, schema):
        return _TreeReader(self.options)
