"""The query of highlights makes positions of the documents that it shows alone."""

from docloom.operators import positions
from docloom.plans.registry import QUERIES


def test_only_what_was_found_gets_positions(spark, monkeypatch):
    seen, plain = [], positions.positions
    monkeypatch.setattr(positions, "positions", lambda docs, *a, **k: seen.append(docs) or plain(docs, *a, **k))
    rows = QUERIES["f18_highlights"](spark, "/root/testdata/sf0.001").select("id").distinct().collect()
    assert 0 < len(rows) <= seen[0].count() < 200 and {r.id for r in rows} <= {r.doc_id for r in seen[0].select("doc_id").collect()}
