"""Incremental reads of a Derby database within the driver's JVM."""

import uuid

import pytest
from pyspark.sql import functions as F

from docloom.sources.sql import Incremental, SqlSource


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = lambda sql: connection.createStatement().execute(sql)
    run("CREATE TABLE notes (id INT, body VARCHAR(200), title VARCHAR(50), owner VARCHAR(20), changed TIMESTAMP)")
    yield url, run
    connection.close()


def make(url, **more):
    return SqlSource(url, "NOTES", "db", "ID", "BODY", "TITLE", "CHANGED", ("OWNER",), **more)


def row(run, i, body, at, title="NULL"):
    run(f"INSERT INTO notes VALUES ({i}, {body}, {title}, 'o{i}', {at})")


def test_documents_metadata_and_pushed_conditions(spark, database):
    url, run = database
    row(run, 1, "'one'", "TIMESTAMP('2024-01-01 00:00:00')", "'T'")
    row(run, 2, "NULL", "NULL")
    row(run, "NULL", "'lost'", "NULL")
    source = make(url)
    got = {r.file_path: r for r in source.documents(source.rows(spark)).collect()}
    assert set(got) == {"1", "2"} and got["1"].title == "T" and got["2"].title == "Row 2" and got["2"].content == ""
    assert got["1"].metadata == {"OWNER": "o1"} and got["1"].last_modified.startswith("2024-01-01")
    plan = source.rows(spark, "2024-01-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "CHANGED" in plan.split("PushedFilters: [")[1].split("]")[0]
    chosen = SqlSource(url, "SELECT id, body FROM notes WHERE id = 1", "db", "ID", "BODY")
    assert [r.content for r in chosen.documents(chosen.rows(spark)).collect()] == ["one"]


def test_a_read_is_split_by_ranges(spark, database):
    url, run = database
    for i in range(40):
        row(run, i, f"'b{i}'", "TIMESTAMP('2024-01-01 00:00:00')")
    rows = make(url, partition_column="ID", partitions=4).rows(spark)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 40
    assert make(url, partition_column="ID").rows(spark, "2030-01-01 00:00:00").count() == 0


def test_equal_marks_are_neither_lost_nor_doubled(spark, database, tmp_path):
    url, run = database
    read = Incremental(spark, make(url), str(tmp_path))
    assert read.pending().count() == 0 and not read.done(read.pending())
    a, b = ("TIMESTAMP('2024-01-01 10:00:00')", "TIMESTAMP('2024-01-02 10:00:00')")
    for i, at in ((1, a), (2, b), (3, "NULL")):
        row(run, i, f"'v{i}'", at)

    def step(keep=True):
        found = read.pending()
        if keep:
            read.done(found)
        return sorted((r.file_path, r.content) for r in found.collect())

    first = [("1", "v1"), ("2", "v2"), ("3", "v3")]
    assert step(keep=False) == first and step() == first and step() == []
    assert read.mark().startswith("2024-01-02")
    row(run, 4, "'v4'", b)  # later, but of the highest mark
    row(run, 5, "'old'", a)  # below the mark: an incremental read does not see it
    assert step() == [("4", "v4")] and step() == []
    run("UPDATE notes SET body = 'w2' WHERE id = 2")  # changed at the same mark
    run("UPDATE notes SET body = 'w3' WHERE id = 3")
    assert step() == [("2", "w2"), ("3", "w3")] and step() == []
    row(run, 6, "'v6'", "TIMESTAMP('2024-02-01 00:00:00')")
    run("UPDATE notes SET body = 'x4', changed = TIMESTAMP('2024-02-01 00:00:00') WHERE id = 4")
    assert step() == [("4", "x4"), ("6", "v6")] and step() == []
    assert {r.doc_id for r in read.store.live("seen").collect()} == {F_id(spark, x) for x in ("3", "4", "6")}


def F_id(spark, key):
    from docloom.functions.text import sha256_id

    return spark.range(1).select(sha256_id(F.lit("db"), F.lit(key)).alias("i")).first().i
