"""Paged interfaces and feeds of a local server."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from docloom.sources import paged

ITEMS = [{"key": {"id": i}, "text": f"é{i}", "name": None if i % 2 else f"n{i}"} for i in range(47)]


class Handler(BaseHTTPRequestHandler):
    asked: list[tuple] = []

    def log_message(self, *a):
        pass

    def do_GET(self, body=None):
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()} | (body or {})
        Handler.asked.append((self.command, url.path, q, self.headers.get("X-Key")))
        if url.path == "/feed":
            data = b"<rss><channel><item><guid>g</guid><title>t</title><description>d</description></item></channel></rss>"
        elif url.path == "/bad":
            data = b"<rss"
        else:
            size = int(q.get("limit") or q.get("per_page") or q.get("n") or 1000)
            at = {"/offset": int(q.get("offset", 0)), "/page": (int(q.get("page", 1)) - 1) * size, "/cursor": int(q.get("after", 0)), "/all": 0}[url.path]
            rows = ITEMS[at : at + size]
            data = json.dumps({"data": {"rows": rows}, "meta": {"total": len(ITEMS), "next": str(at + size) if at + size < len(ITEMS) else None}}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self):
        self.do_GET(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))


@pytest.fixture
def server(spark):
    spark.dataSource.register(paged.PagedSource)
    spark.dataSource.register(paged.FeedSource)
    Handler.asked = []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()
    s.server_close()


def load(spark, **options):
    return spark.read.format("docloom_pages").options(items="data.rows", **options).load()


def ids(rows):
    return sorted(json.loads(r.item)["key"]["id"] for r in rows)


@pytest.mark.parametrize("kind", ["offset", "page"])
def test_pages_are_planned_and_fetched_by_tasks(spark, server, kind):
    rows = load(spark, url=f"{server}/{kind}", paging=kind, size="5", total="meta.total", pages_a_task="3")
    assert rows.rdd.getNumPartitions() == 4
    Handler.asked = []
    got = rows.collect()
    assert ids(got) == list(range(47)) and Counter(r.page for r in got)[9] == 2
    n = Counter(json.dumps(a[2]) for a in Handler.asked)
    assert sum(n.values()) <= 11 and len(n) == 10  # every page once, the first once more to plan
    again = load(spark, url=f"{server}/{kind}", paging=kind, size="5")  # without a total: a chain
    assert again.rdd.getNumPartitions() == 1 and ids(again.collect()) == list(range(47))


def test_cursors_are_one_chain_under_own_names(spark, server):
    rows = load(spark, url=f"{server}/cursor", paging="cursor", size="10", page_param="after", size_param="n", cursor="meta.next").collect()
    assert ids(rows) == list(range(47)) and {r.page for r in rows} == {0, 1, 2, 3, 4}
    assert [a[2].get("after") for a in Handler.asked] == [None, "10", "20", "30", "40"]


def test_headers_bodies_and_documents(spark, server):
    options = {"url": f"{server}/all", "method": "POST", "headers": '{"X-Key": "Key {token}"}', "body": '{"kind": "note"}', "credentials": '{"token": "s3"}'}
    with pytest.raises(Exception, match="no value"):
        load(spark, **options | {"headers": '{"X-Key": "{other}"}'}).collect()
    items = spark.read.format("docloom_pages").options(items="data.rows", **options | {"body": '{"kind": "note"}', "credentials": '{"token": "s3"}'}).load()
    docs = {r.title: r for r in paged.documents(items, "api", "key.id", "text", "name").collect()}
    assert len(docs) == 47 and docs["n0"].content == "é0" and docs["1"].content == "é1" and len(docs["1"].id) == 64
    assert Handler.asked[-1][0] == "POST" and Handler.asked[-1][2] == {"kind": "note"} and Handler.asked[-1][3] == "Key s3"


def test_feeds_each_in_a_task(spark, server):
    rows = spark.read.format("docloom_feeds").options(urls=f"{server}/feed {server}/bad {server}/feed").load()
    assert rows.rdd.getNumPartitions() == 2
    got = {r.feed.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert got["feed"].id == "g" and got["feed"].content == "d" and got["feed"].error is None and "ParseError" in got["bad"].error
    assert spark.read.format("docloom_feeds").load().count() == 0
