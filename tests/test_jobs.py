"""Job rules, and the streaming operators against their batch forms."""

import pytest

from narrata.operators import identity, jobs
from narrata.streaming import stateful


def test_fold(spark):
    rows = [(1, 1, "stage", "queued"), (1, 2, "stage", "done"), (1, 3, "progress", "7"), (1, 4, "stage", "extracting"), (2, 1, "stage", "failed"), (2, 2, "stage", "queued"), (2, 3, "progress", "x"), (2, 4, "stage", "cancelled"), (2, 5, "stage", "failed")]
    got = {r.id: r for r in jobs.fold_events(spark.createDataFrame(rows, "id long, seq long, kind string, value string")).collect()}
    assert (got[1].stage, got[1].progress, got[1].refused) == ("extracting", 1.0, 1)
    assert (got[2].stage, got[2].progress, got[2].refused) == ("cancelled", 0.0, 1)


def test_throttle(spark):
    events = spark.createDataFrame([(1, 100.0)] * 100 + [(1, 161.0)], "user_id long, ts double")
    assert [(r.ts, r.suppressed) for r in jobs.throttled(events, "user_id").orderBy("ts").collect()] == [(100.0, 0), (161.0, 99)]


def test_throttle_of_a_hot_user(spark):
    rows = [(1, float(i)) for i in range(50_000)] + [(2, 3.0), (None, 1.0), (None, 2.0), (3, None)]
    got = jobs.throttled(spark.createDataFrame(rows, "user_id long, ts double"), "user_id").collect()
    assert sorted(r.ts for r in got if r.user_id == 1) == [float(i) for i in range(0, 50_000, 60)]
    assert {r.suppressed for r in got if r.user_id == 1} == {0, 59} and sorted((str(r.user_id), r.ts) for r in got if r.user_id != 1) == [("2", 3.0), ("None", 1.0)]


def test_retry_is_fair(spark):
    def due(last, now):
        j = spark.createDataFrame([(i, "ready", False, "o", t) for i, t in last.items()], "id long, stage string, delivered boolean, output_paths string, last_attempt double")
        from pyspark.sql import functions as F

        return [r.id for r in jobs.retry_due(j, F.lit(now)).collect()]

    assert due({1: None, 2: None}, 0.0) == [1] and due({1: 0.0, 2: None}, 181.0) == [2] and due({1: 0.0, 2: 181.0}, 362.0) == [1] and due({1: 300.0}, 362.0) == []


def test_silence(spark):
    rows = [(1, i, i not in (3, 4, 5)) for i in range(100)] + [(2, i, i % 20 != 0) for i in range(100)] + [(3, 0, False)]
    runs = identity.silence_runs(spark.createDataFrame(rows, "k long, i long, ok boolean"), "k", ["i"], "ok")
    assert {r.k: (r.failed, r.longest, r.abort) for r in identity.silence_aborts(runs).collect()} == {1: (3, 3, True), 2: (5, 1, False), 3: (1, 1, True)}


def streamed(spark, tmp_path, name, batches, schema, f):
    """The rows that f gives for batches that arrive one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = f(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_debounce_stream(spark, tmp_path):
    polls = [[(p, "a", 5, 1.0), (p, "b", p, 1.0)] for p in range(4)]
    got = streamed(spark, tmp_path, "debounced", polls, "poll_no long, path string, size long, mtime double", stateful.debounced)
    assert got == [("a", 1, 5, 1.0)]


def test_throttle_stream(spark, tmp_path):
    batches = [[(1, 100.0)] * 3, [(1, 130.0), (2, 5.0)], [(1, 161.0)]]
    schema = "user_id long, ts double"
    got = streamed(spark, tmp_path, "logged", batches, schema, lambda s: stateful.throttled(s, "user_id"))
    batch = jobs.throttled(spark.createDataFrame(sum(batches, []), schema), "user_id")
    assert got == sorted(map(tuple, batch.collect())) == [(1, 100.0, 0), (1, 161.0, 3), (2, 5.0, 0)]


def test_stage_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, "moved", [[(1, 1, "queued")], [(1, 2, "done"), (1, 3, "extracting")], [(1, 4, "failed"), (1, 5, "cleaning")]], "id long, seq long, value string", stateful.staged)
    assert [(r[2], r[3]) for r in got] == [("queued", True), ("queued", False), ("extracting", True), ("failed", True), ("failed", False)]


def test_token_stream(spark, tmp_path):
    rows = [[("t", 1, "request", 0.0), ("u", 1, "request", 0.0)], [("t", 2, "confirm", 5.0), ("t", 1, "confirm", 9.0), ("u", 1, "confirm", 121.0)], [("t", 1, "confirm", 10.0)]]
    assert streamed(spark, tmp_path, "confirmed", rows, "token string, user_id long, kind string, ts double", stateful.confirmed) == [("t", 1, 0.0, 9.0)]


def test_folder_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("b.txt", "bb"), ("a.txt", "a"), (".hidden", "x"), ("c.part", "x"), ("empty.txt", ""), ("_d.md", "d")):
        (folder / name).write_text(content)

    def taken():
        files = stateful.folder_stream(spark, str(folder)).selectExpr("substring_index(path, '/', -1) AS name", "cast(content AS string) AS text")
        files.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    first = taken()
    (folder / "later.txt").write_text("new")
    assert {("a.txt", "a"), ("b.txt", "bb")} <= set(first) <= {("a.txt", "a"), ("b.txt", "bb"), ("_d.md", "d")}
    assert taken() == sorted([*first, ("later.txt", "new")])  # files that were seen are not read again


def test_handled_stream(spark, tmp_path):
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    polls = [[("a", 1, day(1)), ("b", 1, day(1))], [("a", 1, day(1)), ("b", 2, day(1)), ("a", 1, day(2))], [("a", 1, day(2)), ("b", 1, day(1))]]
    wanted = sorted({r for p in polls for r in p})
    assert streamed(spark, tmp_path, "handled", polls, "path string, size long, mtime timestamp", stateful.unhandled) == wanted
    (tmp_path / "w").mkdir()
    assert streamed(spark, tmp_path / "w", "handled_within", polls, "path string, size long, mtime timestamp", lambda s: stateful.unhandled(s, "30 days")) == wanted


def test_first_of_each_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(identity, "HOT_ROWS", 50)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 200}") for i in range(900)] + [(5, "k5")]
    first = {}
    for i, k in rows:
        first[k] = min(first.get(k, i), i)
    got = identity.first_of_each(spark.createDataFrame(rows, "i long, k string"), "k", "i").collect()
    wanted = [(i, k, first[k] if k is not None and i > first[k] else None) for i, k in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_ingest_guard_with_nulls(spark):
    rows = [("/in/a.txt", 3, None, None), ("/in/a.DOCX", 3, False, True), ("/in/a", None, None, None), ("/in/b", 3, True, True), ("/in/c", 3, False, False), (None, 3, False, True)]
    files = spark.createDataFrame(rows, "path string, length long, is_link boolean, is_regular boolean")
    assert [r.status for r in identity.taken_in(files).collect()] == ["ok", "format", "empty", "link", "not a file", "ok"]
    assert [r.status for r in identity.taken_in(files.select("path", "length")).collect()] == ["ok", "format", "empty", "ok", "ok", "ok"]


@pytest.mark.parametrize(("name", "ok"), [("a/../b", True), ("../a", False), ("/a", False), ("C:/a", False), ("", False)])
def test_member_paths(spark, name, ok):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(name,)], "p string").select(identity.member_path_safe(F.col("p"))).head()[0] is ok
