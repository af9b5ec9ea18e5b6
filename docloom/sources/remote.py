"""Remote stores of documents as Python data sources: listings in partitions, changes as streams with links and cursors for offsets."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import files, web

SCHEMA = "id string, source_id string, title string, content string, url string, path string, space string, status string, labels array<string>, last_modified string, content_hash string, deleted boolean, error string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
#: What fetches: a path below the service's address and parameters, and a body if it is sent as JSON (POST), to the answer; with raw=True its bytes.
Fetch = Callable[..., Any]
#: Pages of changes that a batch of a stream takes at most.
MOST_PAGES = 100


def with_retry(call: Callable[[], dict], tries: int = 4, first: float = 0.25, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """``call``, again after min(first * 2 ** n, most) seconds where it fails in a way that may pass: no connection, 429 or 5xx."""
    for n in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if n == tries - 1 or e.code != 429 and e.code < 500:
                raise
        except OSError:
            if n == tries - 1:
                raise
        sleep(min(first * 2**n, most))
    raise AssertionError("unreachable")


def http(options: dict) -> Fetch:
    """Fetches JSON from ``base_url`` with ``token`` as bearer; an address elsewhere, as downloads have it, gets no token."""
    base, token = options["base_url"].rstrip("/"), options.get("token", "")
    home = urllib.parse.urlsplit(base)[:2]

    def fetch(path: str, params: dict, body: dict | None = None, raw: bool = False, headers: dict | None = None) -> Any:
        url = path if path.startswith(("http://", "https://")) else f"{base}/{path}"
        query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        sent = {"Authorization": f"Bearer {token}"} if token and urllib.parse.urlsplit(url)[:2] == home else {}
        sent |= {"Content-Type": "application/json"} if body is not None else {}
        if options.get("version"):
            sent[options.get("version_header", "Notion-Version")] = options["version"]
        data = json.dumps({k: v for k, v in body.items() if v is not None}).encode() if body is not None else None
        request = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}{query}" if query else url, data=data, headers=sent | (headers or {}))

        def call() -> Any:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.read() if raw else json.load(answer)

        return with_retry(call)

    return fetch


def recorded(options: dict) -> Fetch:
    """Answers from the file ``answers``: a JSON object by path, parameters and body, as ``path?a=1&b=2`` and ``POST path {"a": 1}``."""
    with open(options["answers"], encoding="utf-8") as f:
        known = json.load(f)

    def fetch(path: str, params: dict, body: dict | None = None, raw: bool = False, headers: dict | None = None) -> Any:
        query = urllib.parse.urlencode(sorted((k, v) for k, v in params.items() if v is not None), safe=":/")
        key = f"{path}?{query}" if query else path
        if body is not None:
            key = f"POST {key} {json.dumps({k: v for k, v in sorted(body.items()) if v is not None})}"
        return known[key].encode() if raw else known[key]

    return fetch


def _hash(*parts: object) -> str:
    return sha256(":".join(map(str, parts)).encode()).hexdigest()


class Service:
    """How one interface lists what it has and tells what changed. Subclasses know its requests and answers."""

    def __init__(self, options: dict):
        self.options, self.source = options, options.get("source_id", "remote")
        module, _, name = options.get("client", f"{__name__}:http").partition(":")
        self.make_fetch = getattr(importlib.import_module(module), name)

    @property
    def fetch(self) -> Fetch:
        return self.make_fetch(self.options)

    def row(self, **values: object) -> dict:
        return dict.fromkeys(FIELDS) | {"source_id": self.source, "deleted": False, "labels": []} | values

    def download(self, row: dict) -> bytes | None:
        """The bytes of a file; None for a service whose listing has the text."""
        return None

    def filled(self, rows: Iterator[dict]) -> Iterator[dict]:
        """``rows`` with the text of their files where ``contents`` is asked for; a file that cannot be had or read has an error and stops nothing."""
        wanted = str(self.options.get("contents", "")).lower() == "true"
        for row in rows:
            if wanted and not row["deleted"] and row["content"] is None:
                try:
                    raw = self.download(row)
                    row["content"] = files.read_one(raw, (row["title"] or "").rpartition(".")[2].lower())[0] if raw is not None else None
                except Exception as e:  # whatever a service or a broken file may raise
                    row["error"] = f"{type(e).__name__}: {e}"
            yield row

    def parts(self) -> list[str]:
        """What can be listed apart: folders, spaces, or the whole."""
        return [""]

    def listed(self, part: str) -> Iterator[dict]:
        """The rows of one part, page by page."""
        raise NotImplementedError

    def changed(self, token: str | None) -> tuple[list[dict], str, bool]:
        """The rows of the page of changes at ``token`` (None: from the beginning), the token behind it, whether more follows."""
        raise NotImplementedError(f"{type(self).__name__} has no changes")

    def _folders(self, root: str, children: Callable[[str], list[str]]) -> list[str]:
        found, at = [root], 0
        while at < len(found):
            found += [f for f in children(found[at]) if f not in found]
            at += 1
        return found


class Graph(Service):
    """A drive with folders of items, file hashes and a delta link."""

    def _file(self, x: dict) -> dict:
        modified = x.get("lastModifiedDateTime")
        return self.row(id=x["id"], title=x.get("name") or x["id"], url=x.get("webUrl"), path=x.get("name"), last_modified=modified, content_hash=((x.get("file") or {}).get("hashes") or {}).get("quickXorHash") or _hash(x["id"], modified))

    def download(self, row: dict) -> bytes:
        return self.fetch(f"items/{row['id']}/content", {}, raw=True)

    def _children(self, folder: str) -> Iterator[dict]:
        answer = self.fetch(f"items/{folder}/children", {})
        while True:
            yield from answer.get("value", [])
            if not answer.get("@odata.nextLink"):
                return
            answer = self.fetch(answer["@odata.nextLink"], {})

    def parts(self) -> list[str]:
        return self._folders(self.options.get("root", "root"), lambda f: [x["id"] for x in self._children(f) if "folder" in x])

    def listed(self, part: str) -> Iterator[dict]:
        return (self._file(x) for x in self._children(part) if "file" in x)

    def changed(self, token: str | None) -> tuple[list[dict], str, bool]:
        answer = self.fetch(token or "root/delta", {})
        rows = [self.row(id=x["id"], deleted=True) if "deleted" in x else self._file(x) for x in answer.get("value", []) if "deleted" in x or "file" in x]
        return rows, answer.get("@odata.nextLink") or answer["@odata.deltaLink"], "@odata.nextLink" in answer


class Cursor(Service):
    """A store of entries that is listed, and followed, by a cursor."""

    def _entry(self, x: dict) -> dict:
        if x.get(".tag") == "deleted":
            return self.row(id=x.get("id") or x["path_lower"], path=x.get("path_lower"), deleted=True)
        modified = x.get("server_modified")
        return self.row(id=x["id"], title=x.get("name") or x["id"], path=x.get("path_lower") or x.get("name"), last_modified=modified, content_hash=x.get("content_hash") or _hash(x["id"], modified))

    def changed(self, token: str | None) -> tuple[list[dict], str, bool]:
        path = self.options.get("root", "")
        answer = self.fetch("files/list_folder/continue", {}, {"cursor": token}) if token else self.fetch("files/list_folder", {}, {"path": path, "recursive": True})
        return [self._entry(x) for x in answer.get("entries", []) if x.get(".tag") != "folder"], answer["cursor"], bool(answer.get("has_more"))

    def download(self, row: dict) -> bytes:
        """Files come from another address, with the file's name in a header."""
        address = self.options.get("content_url", "https://content.dropboxapi.com/2").rstrip("/")
        sent = {"Dropbox-API-Arg": json.dumps({"path": row["id"]}), "Content-Type": "application/octet-stream"}
        if self.options.get("token"):
            sent["Authorization"] = f"Bearer {self.options['token']}"
        return self.fetch(f"{address}/files/download", {}, {}, raw=True, headers=sent)

    def listed(self, part: str) -> Iterator[dict]:
        token, more = None, True
        while more:
            rows, token, more = self.changed(token)
            yield from (r for r in rows if not r["deleted"])


class Folders(Service):
    """A drive that is asked for the files of a folder by type, page by page."""

    FOLDER = "application/vnd.google-apps.folder"

    def download(self, row: dict) -> bytes:
        return self.fetch(f"files/{row['id']}", {"alt": "media"}, raw=True)

    def _files(self, folder: str) -> Iterator[dict]:
        page = None
        while True:
            answer = self.fetch("files", {"q": f"'{folder}' in parents and trashed = false", "pageToken": page})
            yield from answer.get("files", [])
            page = answer.get("nextPageToken")
            if not page:
                return

    def parts(self) -> list[str]:
        return self._folders(self.options.get("root", "root"), lambda f: [x["id"] for x in self._files(f) if x.get("mimeType") == self.FOLDER])

    def listed(self, part: str) -> Iterator[dict]:
        kinds = [k for k in self.options.get("mime_types", "").split(",") if k]
        for x in self._files(part):
            if x.get("mimeType") != self.FOLDER and (not kinds or x.get("mimeType") in kinds):
                text = self.fetch(f"files/{x['id']}/export", {"mimeType": "text/plain"}, raw=True).decode("utf-8", "replace") if x.get("mimeType", "").startswith("application/vnd.google-apps.") else None
                yield self.row(id=x["id"], title=x.get("name") or x["id"], content=text, url=x.get("webViewLink"), path=x.get("name"), last_modified=x.get("modifiedTime"), content_hash=x.get("md5Checksum") or _hash(x["id"], x.get("modifiedTime")))


class Wiki(Service):
    """Pages of the spaces of a wiki, as text; spaces, states and a label are asked of the service, not filtered here."""

    #: What an answer holds beyond names: the body, dates and labels.
    EXPAND = "body.storage,version,history.lastUpdated,metadata.labels"

    def parts(self) -> list[str]:
        return [s for s in self.options.get("spaces", "").split(",") if s]

    def listed(self, part: str) -> Iterator[dict]:
        for state in self.options.get("status", "current").split(","):
            yield from self._pages(part, state)

    def _pages(self, space: str, state: str) -> Iterator[dict]:
        size, start = min(int(self.options.get("page_size", 100)), 100), 0
        while True:
            answer = self.fetch("content", {"spaceKey": space, "type": "page", "status": state, "label": self.options.get("label"), "expand": self.EXPAND, "start": start, "limit": size})
            pages = answer.get("results", [])
            for x in pages:
                labels = [y["name"] for y in x.get("metadata", {}).get("labels", {}).get("results", []) if y.get("name")]
                body = web.plain(x.get("body", {}).get("storage", {}).get("value", ""))
                updated = x.get("history", {}).get("lastUpdated", {}).get("when") or x.get("version", {}).get("when")
                yield self.row(id=_hash(self.source, x.get("id", "")), title=x.get("title") or x.get("id"), content=body, url=x.get("_links", {}).get("webui"), path=f"{space}/{x.get('title', '')}", space=space, status=x.get("status", state), labels=labels, last_modified=updated, content_hash=_hash(body))
            start += len(pages)
            if len(pages) < size:
                return


class Database(Service):
    """The rows of a database of pages, by a cursor and a filter (JSON) of the service's own."""

    def _blocks(self, page: str) -> list[dict]:
        found, cursor, more = [], None, True
        while more:
            answer = self.fetch(f"blocks/{page}/children", {"start_cursor": cursor})
            found += answer.get("results", [])
            cursor, more = answer.get("next_cursor"), bool(answer.get("has_more"))
        return found

    def listed(self, part: str) -> Iterator[dict]:
        from .records import notion_text

        cursor = None
        while True:
            chosen = self.options.get("filter")
            answer = self.fetch(f"databases/{self.options['database']}/query", {}, {"filter": json.loads(chosen) if chosen else None, "start_cursor": cursor, "page_size": 100})
            for x in answer.get("results", []):
                title = "".join(t.get("plain_text", "") for p in x.get("properties", {}).values() if p.get("type") == "title" for t in p.get("title", []))
                text = notion_text(self._blocks(x["id"]))
                yield self.row(id=x["id"], title=title or x["id"], content=text, url=x.get("url"), last_modified=x.get("last_edited_time"), content_hash=_hash(text))
            cursor = answer.get("next_cursor")
            if not answer.get("has_more"):
                return


SERVICES: dict[str, type[Service]] = {"graph": Graph, "cursor": Cursor, "folders": Folders, "wiki": Wiki, "database": Database}


class _Part(InputPartition):
    def __init__(self, value: str | None):
        self.value = value


def _tuples(rows: Iterator[dict]) -> Iterator[tuple]:
    return (tuple(r[f] for f in FIELDS) for r in rows)


class _Reader(DataSourceReader):
    """Each part is a task."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in SERVICES[self.options["service"]](self.options).parts()] or [_Part(None)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.value is not None:
            service = SERVICES[self.options["service"]](self.options)
            yield from _tuples(service.filled(service.listed(partition.value)))


class _FilteredReader(_Reader):
    """Filters on space and status go to a wiki, which can be asked for them; all others stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Each filter narrows what is asked for further; without one, and without the option, a wiki is asked for its current pages."""
        asked = {n: {x for x in self.options.get(o, "").split(",") if x} or None for n, o in (("space", "spaces"), ("status", "status"))}
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if name not in asked:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            asked[name] = values if asked[name] is None else asked[name] & values
        self.nothing = any(x is not None and not x for x in asked.values())
        self.options |= {o: ",".join(sorted(asked[n])) for n, o in (("space", "spaces"), ("status", "status")) if asked[n]}

    nothing = False

    def partitions(self) -> list[InputPartition]:
        return [_Part(None)] if self.nothing else super().partitions()


class _StreamReader(DataSourceStreamReader):
    """An offset names the token behind it and the tokens of all its pages, and where these begin: a batch reads exactly those, whatever
    tokens the service gives the next time. Each page is a task that fetches it, so a lost task is read anew. The
    driver asks for each page once, for the token that follows, and for ``max_pages`` a batch at most.
    """

    def __init__(self, options: dict):
        self.service = SERVICES[options["service"]](dict(options))
        self.most = int(options.get("max_pages", MOST_PAGES))
        resume = options.get("resume")
        self.at: dict = json.loads(resume) if resume else self.initialOffset()

    def initialOffset(self) -> dict:
        return {"token": None, "after": None, "pages": []}

    def latestOffset(self) -> dict:
        token, pages = self.at["token"], []
        while len(pages) < self.most:
            rows, after, more = self.service.changed(token)
            if not rows and not more:
                break
            pages.append(token)
            token = after
        if pages:
            self.at = {"token": token, "after": self.at["token"], "pages": pages}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["token"] == end["token"]:
            return []
        pages = end["pages"]
        if end["after"] != start["token"]:  # a reader that began anew: what it found again goes, where tokens tell
            if start["token"] not in pages:
                raise ValueError("the service gives other tokens than before: start the stream by remote.changes, which resumes from the checkpoint")
            pages = pages[pages.index(start["token"]) :]
        return [_Part(token) for token in pages]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _tuples(self.service.filled(iter(self.service.changed(partition.value)[0])))

    def commit(self, end: dict) -> None:
        pass


def changes(spark: SparkSession, checkpoint: str, **options: str) -> DataFrame:
    """The stream of changes of a remote source that goes on from the offsets of ``checkpoint``, if it has any, without walking all pages again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(n) for s in fs.listStatus(path) if (n := s.getPath().getName()).isdigit()] if fs.exists(path) else []
    if numbers:
        lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{max(numbers)}").collect()]
        options["resume"] = next(x for x in lines if x.startswith("{") and '"token"' in x)
    spark.dataSource.register(RemoteSource)
    return spark.readStream.format("docloom_remote").options(**options).load()


class RemoteSource(DataSource):
    """Format ``docloom_remote``. Options: ``service`` (a name of SERVICES), ``source_id``, the service's own, and ``client``, the
    module:function that makes what fetches (http by default, with ``base_url`` and ``token``).

    With ``push_filters`` a wiki gets filters on space and status; that needs spark.sql.python.filterPushdown.enabled.
    With ``contents`` rows have the text of their files. A batch has what is there; a stream has changes, ``deleted`` where something went, from the first listing on.
    """

    @classmethod
    def name(cls) -> str:
        return "docloom_remote"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushes = self.options["service"] == "wiki" and str(self.options.get("push_filters", "")).lower() == "true"
        return (_FilteredReader if pushes else _Reader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
