"""Figures merged from hours against the log itself."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import figures, monitoring

LOG = "id long, ts timestamp_ntz, user_id long, total_latency_ms int, success boolean, cost double, feedback string"


@pytest.fixture(scope="module")
def log(spark):
    rnd, start = random.Random(8), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rnd.randint(0, 60 * 72 - 1)), rnd.randint(0, 5000), int(rnd.lognormvariate(6, 1.5)), rnd.random() < 0.9, rnd.random() / 100, rnd.choice([None, "positive", "negative"])) for i in range(20_000)]
    rows += [(-1, None, 1, 1, True, 0.1, None), (-2, start, None, None, None, None, None), (-3, start, 1, 0, True, 0.0, None)]
    return spark.createDataFrame(rows, LOG).repartition(5).cache()


@pytest.mark.parametrize("a,b", [(0, 72), (10, 11), (20, 50)])
def test_any_window_is_exact_but_for_the_sketches(spark, log, a, b):
    start, end = (datetime(2024, 1, 1) + timedelta(hours=h) for h in (a, b))
    inside = log.where((F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(end)).cast("timestamp_ntz")))
    got = figures.metrics(figures.summaries(log), str(start), str(end)).first()
    want = monitoring.metrics(inside, str(end), 24 * 30).first()
    for c in ("total_queries", "success_rate", "avg_latency_ms", "total_cost_usd", "negative_feedback_rate"):
        assert got[c] == pytest.approx(want[c], abs=1e-6)
    lat = sorted(r[0] for r in inside.where("total_latency_ms > 0").select("total_latency_ms").collect())
    below = sum(x <= got.p95_latency_ms for x in lat) / len(lat)
    assert abs(below - 0.95) < 0.02 + 1 / len(lat)
    users = inside.select("user_id").where("user_id is not null").distinct().count()
    assert abs(got.users - users) <= max(1, 0.06 * users)


def test_days_of_hours_and_an_empty_window(spark, log):
    hours = figures.summaries(log)
    days = figures.rolled(hours)
    assert days.count() == 3 and hours.count() == 72
    a, b = (figures.metrics(x, "2024-01-02", "2024-01-03").first() for x in (hours, days))
    assert a.total_queries == b.total_queries and a.total_cost_usd == b.total_cost_usd and abs(a.users - b.users) <= 0.05 * a.users
    assert tuple(figures.metrics(hours, "2020-01-01", "2020-01-02").first()) == (0, 0.0, 0, 0, 0.0, 0.0, 0)


def test_batches_come_once_and_late_entries_join_their_hour(spark, log, tmp_path):
    kept = figures.Figures(spark, str(tmp_path), fanout=2)
    for n in range(3):
        assert kept.add(log.where((F.col("id") >= 0) & (F.col("id") % 3 == n)), "log", n)
    assert not kept.add(log, "log", 1)
    assert kept.hours().count() == 72
    a, b = (figures.metrics(x, "2024-01-01", "2024-01-04").first() for x in (kept.hours(), figures.summaries(log.where("id >= 0"))))
    assert a.total_queries == b.total_queries and a.avg_latency_ms == b.avg_latency_ms and a.total_cost_usd == b.total_cost_usd
