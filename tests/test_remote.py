"""Remote listings and changes over recorded answers, repositories, buckets, mail."""

import json
import subprocess
import threading
from email.message import EmailMessage
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from docloom.sources import remote, repositories, web


@pytest.fixture
def answers(tmp_path):
    def write(found: dict) -> str:
        path = tmp_path / "answers.json"
        path.write_text(json.dumps(found))
        return str(path)

    return write


def load(spark, service, answers, **options):
    spark.dataSource.register(remote.RemoteSource)
    return spark.read.format("docloom_remote").options(service=service, source_id="s", client="docloom.sources.remote:recorded", answers=answers, **options).load()


def test_drives_are_listed_folder_by_folder(spark, answers):
    path = answers({
        "items/root/children": {"value": [{"id": "f", "folder": {}}, {"id": "a", "name": "a.md", "file": {"hashes": {"quickXorHash": "h"}}}], "@odata.nextLink": "more"},
        "more": {"value": [{"id": "b", "name": "b.md", "file": {}, "lastModifiedDateTime": "t"}]},
        "items/f/children": {"value": [{"id": "c", "name": "c.md", "file": {}}]},
    })
    rows = {r.id: r for r in load(spark, "graph", path).collect()}
    assert sorted(rows) == ["a", "b", "c"] and rows["a"].content_hash == "h" and len(rows["b"].content_hash) == 64 and not rows["a"].deleted


def test_folders_pages_and_types(spark, answers):
    key = lambda f, page=None: remote.urllib.parse.urlencode(sorted(({"q": f"'{f}' in parents and trashed = false"} | ({"pageToken": page} if page else {})).items()), safe=":/")
    folder = remote.Folders.FOLDER
    path = answers({
        f"files?{key('root')}": {"files": [{"id": "d", "mimeType": folder}], "nextPageToken": "2"},
        f"files?{key('root', '2')}": {"files": [{"id": "x", "mimeType": "text/plain", "md5Checksum": "m"}, {"id": "y", "mimeType": "image/png"}]},
        f"files?{key('d')}": {"files": [{"id": "g", "name": "doc", "mimeType": "application/vnd.google-apps.document"}]},
        "files/g/export?mimeType=text/plain": "exported",
    })
    rows = {r.id: r for r in load(spark, "folders", path, mime_types="text/plain,application/vnd.google-apps.document").collect()}
    assert sorted(rows) == ["g", "x"] and rows["g"].content == "exported" and rows["x"].content_hash == "m"


def test_wiki_filters_reach_the_service(spark, answers):
    page = lambda i, label: {"id": i, "title": f"t{i}", "status": "current", "body": {"storage": {"value": "<p>x</p>"}}, "metadata": {"labels": {"results": [{"name": label}]}}}
    one = lambda space, start, status="current": f"content?expand={remote.urllib.parse.quote(remote.Wiki.EXPAND)}&limit=2&spaceKey={space}&start={start}&status={status}&type=page"
    # a space that is filtered out has no answers: asking for it would fail
    path = answers({one("A", 0): {"results": [page("1", "l"), page("2", "m")]}, one("A", 2): {"results": []}, one("A", 0, "archived"): {"results": [page("3", "n") | {"status": "archived"}]}})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = load(spark, "wiki", path, spaces="A,B", page_size="2", push_filters="true").where("space = 'A'").collect()
    assert [(r.title, r.labels, r.space) for r in sorted(rows, key=lambda r: r.title)] == [("t1", ["l"], "A"), ("t2", ["m"], "A")]
    assert {r.content for r in rows} == {"x"}
    pages = load(spark, "wiki", path, spaces="A,B", page_size="2", push_filters="true")
    both = pages.where("space = 'A' AND status IN ('current', 'archived')").collect()
    assert sorted((r.title, r.status) for r in both) == [("t1", "current"), ("t2", "current"), ("t3", "archived")]
    assert pages.where("space = 'A' AND space = 'B' AND space = 'C'").count() == 0 and pages.where("space = 'C'").count() == 0


def test_database_pages(spark, answers):
    block = {"results": [{"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "Head"}]}}]}
    title = {"Name": {"type": "title", "title": [{"plain_text": "T"}]}}
    path = answers({
        'POST databases/d/query {"page_size": 100}': {"results": [{"id": "1", "properties": title}], "has_more": True, "next_cursor": "c"},
        'POST databases/d/query {"page_size": 100, "start_cursor": "c"}': {"results": [{"id": "2"}], "has_more": False},
        "blocks/1/children": block, "blocks/2/children": {"results": []},
    })
    assert [(r.id, r.title, r.content) for r in load(spark, "database", path, database="d").orderBy("id").collect()] == [("1", "T", "# Head"), ("2", "2", "")]


def test_changes_stream_from_link_to_link(spark, answers, tmp_path):
    spark.dataSource.register(remote.RemoteSource)
    found = {"root/delta": {"value": [{"id": "a", "name": "a", "file": {}}], "@odata.nextLink": "p2"}, "p2": {"value": [{"id": "b", "name": "b", "file": {}}], "@odata.deltaLink": "d1"}, "d1": {"value": [], "@odata.deltaLink": "d1"}}
    path = answers(found)

    def run():
        stream = spark.readStream.format("docloom_remote").options(service="graph", source_id="s", client="docloom.sources.remote:recorded", answers=path).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.id, r.deleted) for r in spark.read.schema(remote.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", False), ("b", False)]
    found["d1"] = {"value": [{"id": "a", "deleted": {}}, {"id": "c", "name": "c", "file": {}}], "@odata.deltaLink": "d2"}
    found["d2"] = {"value": [], "@odata.deltaLink": "d2"}
    answers(found)
    assert run() == [("a", False), ("a", True), ("b", False), ("c", False)]


def test_cursor_service(answers):
    path = answers({
        'POST files/list_folder {"path": "", "recursive": true}': {"entries": [{".tag": "file", "id": "1", "name": "x"}, {".tag": "folder", "id": "2"}], "cursor": "c1", "has_more": True},
        'POST files/list_folder/continue {"cursor": "c1"}': {"entries": [{".tag": "deleted", "path_lower": "/gone"}, {".tag": "file", "id": "3", "content_hash": "h"}], "cursor": "c2", "has_more": False},
    })
    s = remote.Cursor({"client": "docloom.sources.remote:recorded", "answers": path})
    assert [r["id"] for r in s.listed("")] == ["1", "3"]
    rows, token, more = s.changed("c1")
    assert [(r["id"], r["deleted"]) for r in rows] == [("/gone", True), ("3", False)] and (token, more) == ("c2", False)


class Drive(BaseHTTPRequestHandler):
    """A drive that gives new tokens with every answer, and checks how it is asked."""

    log: list[tuple] = []
    asked: list[str] = []
    moves = 0

    def log_message(self, *a):
        pass

    def _send(self, data: bytes, code: int = 200):
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        cls, url = type(self), urlsplit(self.path)
        cls.asked.append(f"GET {self.path} {self.headers.get('Authorization')}")
        if url.path.endswith("/content"):
            item = url.path.split("/")[-2]
            return self._send(b"{" if item == "bad" else f"text of {item}".encode(), 404 if item == "gone" else 200)
        at = int(parse_qs(url.query).get("at", ["0"])[0])
        cls.moves += 1
        rows = [{"id": i, "name": f"{i}.{'json' if i == 'bad' else 'txt'}", "file": {}} if not gone else {"id": i, "deleted": {}} for i, gone in cls.log[at : at + 2]]
        key = "@odata.nextLink" if at + 2 < len(cls.log) else "@odata.deltaLink"
        link = f"http://127.0.0.1:{self.server.server_port}/root/delta?at={min(at + 2, len(cls.log))}&token={cls.moves}"
        self._send(json.dumps({"value": rows, key: link}).encode())

    def do_POST(self):
        cls = type(self)
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        cls.asked.append(f"POST {self.path} {body} {self.headers.get('Content-Type')}")
        self._send(json.dumps({"entries": [{".tag": "file", "id": "id:1", "name": "a.txt"}], "cursor": "c", "has_more": False, "results": []}).encode())


@pytest.fixture
def drive():
    Drive.log, Drive.asked, Drive.moves = [], [], 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Drive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_changes_come_once_though_tokens_are_new_each_time(spark, drive, tmp_path):
    def run(**options):
        rows = remote.changes(spark, str(tmp_path / "check"), service="graph", base_url=drive, token="t", **options)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.id, r.deleted) for r in spark.read.schema(remote.SCHEMA).parquet(str(tmp_path / "out")).collect())

    Drive.log = [(x, False) for x in "abc"]
    assert run() == [("a", False), ("b", False), ("c", False)]
    Drive.log += [("a", True), ("d", False), ("e", False)]
    want = [("a", False), ("a", True), ("b", False), ("c", False), ("d", False), ("e", False)]
    Drive.asked = []
    assert run() == want
    assert not any("at=0" in x or x.startswith("GET /root/delta Bearer") for x in Drive.asked)  # nothing is walked again
    assert run(max_pages="1") == want


def test_a_batch_reads_the_pages_of_its_offset_and_no_more(drive):
    Drive.log = [(str(i), False) for i in range(5)]
    reader = remote._StreamReader({"service": "graph", "base_url": drive, "max_pages": "2"})
    ids = lambda parts: [r[0] for p in parts for r in reader.read(p)]
    start, first = reader.initialOffset(), reader.latestOffset()
    Drive.log.append(("late", False))
    assert ids(reader.partitions(start, first)) == ["0", "1", "2", "3"]
    second = reader.latestOffset()
    assert ids(reader.partitions(first, second)) == ["4", "late"] and reader.latestOffset() == second
    anew = remote._StreamReader({"service": "graph", "base_url": drive})
    with pytest.raises(ValueError, match="remote.changes"):
        anew.partitions(first, anew.latestOffset())
    resumed = remote._StreamReader({"service": "graph", "base_url": drive, "resume": json.dumps(first)})
    assert ids(resumed.partitions(first, resumed.latestOffset())) == ["4", "late"]


def test_contents_methods_and_tokens(spark, drive):
    spark.dataSource.register(remote.RemoteSource)
    make = lambda **o: remote.Service(o).fetch
    Drive.log = [("x", False), ("bad", False), ("gone", False)]
    drive_of = remote.Graph({"base_url": drive, "token": "t", "contents": "true"})
    rows = {r["id"]: r for r in drive_of.filled(iter(drive_of.changed(None)[0] + [drive_of.row(id="gone", title="gone.txt")]))}
    assert rows["x"]["content"] == "text of x" and "JSONDecodeError" in rows["bad"]["error"] and "404" in rows["gone"]["error"]
    box = remote.Cursor({"base_url": drive, "token": "t"})
    assert [r["id"] for r in box.listed("")] == ["id:1"]
    assert Drive.asked[-1] == 'POST /files/list_folder {"path": "", "recursive": true} application/json'
    assert list(remote.Database({"base_url": drive, "database": "d", "filter": '{"property": "p"}'}).listed("")) == []
    assert Drive.asked[-1] == 'POST /databases/d/query {"filter": {"property": "p"}, "page_size": 100} application/json'
    other = drive.replace("127.0.0.1", "localhost")
    make(base_url=other, token="secret")(f"{drive}/root/delta", {})
    assert Drive.asked[-1].endswith(" None")  # the token stays at home
    make(base_url=drive, token="secret")("root/delta", {"a": "1"})
    assert Drive.asked[-1] == "GET /root/delta?a=1 Bearer secret"


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fails(n):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise OSError("down")
            return {"ok": True}

        return call

    assert remote.with_retry(fails(2), sleep=waits.append) == {"ok": True} and waits == [0.25, 0.5]
    calls.clear()
    with pytest.raises(OSError):
        remote.with_retry(fails(9), tries=3, sleep=waits.append)


def test_repository_and_bucket(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "README.md").write_text("hello")
    (root / "src" / "a.py").write_text("x = 1")
    (root / "src" / "b.txt").write_text("long text " * 10)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "."), git("commit", "-qm", "m")
    assert repositories.checkout(str(root), "unused") == str(root)
    copy = repositories.checkout(f"file://{root}", str(tmp_path / "copy"))
    (root / "c.md").write_text("new")
    git("add", "."), git("commit", "-qm", "n")
    assert repositories.checkout(f"file://{root}", copy) == copy
    every = {r.file_path: r.content for r in repositories.repository(spark, copy, "s").collect()}
    assert every == {"README.md": "hello", "src/a.py": "x = 1", "src/b.txt": "long text " * 10, "c.md": "new"}
    assert [r.title for r in repositories.repository(spark, copy, "s", readme_only=True).collect()] == ["README.md"]
    assert [r.title for r in repositories.repository(spark, copy, "s", types=("py",)).collect()] == ["a.py"]
    assert {r.title for r in repositories.bucket(spark, str(root / "src"), "s", max_bytes=50, with_content=False).collect()} == {"a.py"}


def test_mail(spark):
    m = EmailMessage()
    m["Subject"], m["From"], m["Message-ID"], m["Date"] = "Grüße", "a@b.c", "<1@x>", "Mon, 01 Jan 2024 10:00:00 +0000"
    m.set_content("Hello\nthere  ")
    h = EmailMessage()
    h.set_content("<p>Only <b>html</b></p>", subtype="html")
    rows = spark.createDataFrame([(bytes(m),), (bytes(h),), (b"",)], "content binary")
    got = repositories.mailbox(rows, "s").collect()
    assert (got[0].title, got[0].content, got[0].author, got[0].last_modified) == ("Grüße", "Hello\nthere", "a@b.c", "2024-01-01T10:00:00+00:00")
    assert " ".join(got[1].content.split()) == "Only html" and got[2].content == "" and len({r.id for r in got}) == 3


def test_crawl_keeps_to_robots(spark):
    pages = spark.createDataFrame([("http://a/", '<a href="/x">x</a><a href="/private/y">y</a>'), ("http://a/x", ""), ("http://a/private/y", "")], "url string, html string")
    rules = spark.createDataFrame([("A", "User-agent: *\nDisallow: /private/")], "host string, text string")
    start = pages.where(F.col("url") == "http://a/")
    assert {r.url for r in web.crawl(pages, start, 2, robots=rules).collect()} == {"http://a/", "http://a/x"}
    assert web.crawl(pages, start, 2).count() == 3
