"""Interfaces that answer in pages, and feeds, as Python data sources: pages are planned from the first answer and fetched by tasks."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import json_path, sha256_id
from .records import feed_entries, next_page
from .remote import with_retry

#: Pages that a task fetches; pages that a chain follows at most.
PAGES, MOST_PAGES = 10, 100_000
PAGED = "page int, item string"
FEED = "feed string, id string, title string, content string, published string, error string"


def filled(template: str, values: dict[str, str]) -> str:
    """``template`` with the value of each {name}; a name without one is an error, as it would be sent as it stands."""
    missing = [n for n in re.findall(r"\{(\w+)\}", template) if n not in values]
    if missing:
        raise ValueError(f"no value for {missing}")
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template)


def at_path(value: Any, path: str) -> Any:
    """What a dotted path names in an answer: keys, or places in lists; the answer itself for an empty path."""
    for key in path.split(".") if path else ():
        if isinstance(value, list) and key.isdigit():
            value = value[int(key)] if int(key) < len(value) else None
        else:
            value = value.get(key) if isinstance(value, dict) else None
    return value


class Pages:
    """Requests of one interface. Options: ``url``; ``method`` GET or POST; ``headers``, ``params`` and ``body`` as JSON, in whose texts {name} stands
    for a value of ``credentials`` (JSON); ``paging`` none, offset, page or cursor, its names ``page_param`` and ``size_param``, ``size``; the dotted paths ``items``, ``total`` and ``cursor``."""

    def __init__(self, options: dict):
        self.o = dict(options)
        self.kind, self.size = self.o.get("paging", "none"), int(self.o.get("size", 100))
        if self.kind not in ("none", "offset", "page", "cursor"):
            raise ValueError(f"unknown paging: {self.kind}")
        secret = json.loads(self.o.get("credentials", "{}"))
        self.headers, self.params = ({k: filled(str(v), secret) for k, v in json.loads(self.o.get(n, "{}")).items()} for n in ("headers", "params"))
        self.body = json.loads(filled(self.o["body"], secret)) if "body" in self.o and secret else json.loads(self.o.get("body", "null"))

    def names(self, number: int, cursor: str | None = None) -> dict:
        """The paging parameters of page ``number``, by the interface's own names."""
        asked = next_page(self.kind, number, self.size, {"next": cursor} if cursor else None, "next") or {}
        if self.kind == "cursor":
            asked = {"limit": self.size} | ({"cursor": cursor} if cursor else {})
        own = {"offset": self.o.get("page_param", "offset"), "page": self.o.get("page_param", "page"), "cursor": self.o.get("page_param", "cursor"), "limit": self.o.get("size_param", "limit"), "per_page": self.o.get("size_param", "per_page")}
        return {own[k]: v for k, v in asked.items()}

    def fetch(self, number: int, cursor: str | None = None) -> Any:
        asked = self.params | self.names(number, cursor)
        data = json.dumps((self.body or {}) | asked).encode() if self.o.get("method", "GET").upper() == "POST" else None
        query = "" if data else urllib.parse.urlencode(asked)
        url = self.o["url"] + (("&" if "?" in self.o["url"] else "?") + query if query else "")
        request = urllib.request.Request(url, data=data, headers=({"Content-Type": "application/json"} if data else {}) | self.headers)

        def call() -> Any:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)

        return with_retry(call)

    def items(self, answer: Any) -> list:
        found = at_path(answer, self.o.get("items", "items"))
        return found if isinstance(found, list) else []


class _Range(InputPartition):
    """Pages ``first`` to before ``end``; a chain from the first page on, by cursor or to a short page, where ``end`` is None."""

    def __init__(self, first: int, end: int | None):
        self.first, self.end = first, end


class _PagedReader(DataSourceReader):
    """The first answer tells, by ``total``, how many pages there are: each task gets a range of them, and one that is lost asks for
    its own again. Without a total, and with cursors, which only the answer before gives, pages are one chain in one task."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        pages = Pages(self.options)
        total = self.options.get("total")
        if pages.kind not in ("offset", "page") or not total:
            return [_Range(0, None if pages.kind != "none" else 1)]
        n = at_path(pages.fetch(0), total)
        if not isinstance(n, int) or n < 0:
            raise ValueError(f"{total} is no number of items: {n!r}")
        count, each = -(-n // pages.size), int(self.options.get("pages_a_task", PAGES))
        return [_Range(a, min(a + each, count)) for a in range(0, count, each)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        pages, cursor, number = Pages(self.options), None, partition.first
        while partition.end is None or number < partition.end:
            if number - partition.first >= MOST_PAGES:
                raise ValueError(f"more than {MOST_PAGES} pages in one chain")
            answer = pages.fetch(number, cursor)
            items = pages.items(answer)
            for item in items:
                yield number, json.dumps(item, ensure_ascii=False)
            number += 1
            if partition.end is None:
                cursor = at_path(answer, self.options.get("cursor", "next")) if pages.kind == "cursor" else None
                if not items or (not cursor if pages.kind == "cursor" else len(items) < pages.size):
                    return


class PagedSource(DataSource):
    """Format ``docloom_pages``: (page, item as JSON) of an interface; see Pages for its options, and ``pages_a_task``."""

    @classmethod
    def name(cls) -> str:
        return "docloom_pages"

    def schema(self) -> str:
        return PAGED

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


def documents(items: DataFrame, source_id: str, id_path: str, content_path: str, title_path: str | None = None) -> DataFrame:
    """(id, source_id, title, content, content_hash) of items, by the paths of their fields; an item without an id goes, a missing title is its id."""
    key, text = json_path(F.col("item"), id_path), F.coalesce(json_path(F.col("item"), content_path), F.lit(""))
    title = F.coalesce(json_path(F.col("item"), title_path) if title_path else F.lit(None).cast("string"), key)
    return items.where(key.isNotNull()).select(sha256_id(F.lit(source_id), key).alias("id"), F.lit(source_id).alias("source_id"), title.alias("title"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))


class _Feed(InputPartition):
    def __init__(self, url: str | None):
        self.url = url


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Feed(u) for u in dict.fromkeys(self.options.get("urls", "").split())] or [_Feed(None)]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        if partition.url is None:
            return

        def call() -> str:
            with urllib.request.urlopen(partition.url, timeout=60) as answer:
                return answer.read().decode("utf-8", "replace")

        try:
            for e in feed_entries(with_retry(call), int(self.options.get("max_items", 100))):
                yield partition.url, e["id"], e["title"], e["content"], e["published"], None
        except Exception as e:  # a feed that is gone or broken stops no other
            yield partition.url, None, None, None, None, f"{type(e).__name__}: {e}"


class FeedSource(DataSource):
    """Format ``docloom_feeds``: the entries of the feeds at ``urls`` (white space between them), a task each, at most ``max_items`` of each; a feed that cannot be read is one row with its error."""

    @classmethod
    def name(cls) -> str:
        return "docloom_feeds"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)
