"""Streams over several batches give what one batch over everything gives."""

from pyspark.sql import functions as F

from buildlark.operators import templates as tm
from buildlark.streaming import streams as st


def test_builds_resent_in_later_batches(spark, tmp_path):
    ddl = st.schemas.BUILD_EVENT
    first = [(f"j{i % 2}", i, "IN_PROGRESS", 1, f"2024-01-01T00:00:{i:02d}", "u/first", "all fine", False) for i in range(6)]
    again = [(f"j{i % 2}", i, "FAILURE", 2, f"2024-01-01T00:00:{i:02d}", "u/second", "ERROR failed", True) for i in range(3)]
    src, root = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    events = spark.readStream.schema(ddl).json(str(src))
    for rows in (first, again):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(src))
        st.follow_builds(events, root, str(tmp_path / "cp")).awaitTermination()
    got = {r.build_number: r for r in st.current_builds(spark, root).collect()}
    assert len(got) == 6
    assert all(got[i].status == "FAILURE" and got[i].predicted_failure and got[i].prediction_correct for i in range(3))
    assert all(got[i].build_url == "u/first" and not got[i].is_demo for i in range(6))
    assert all(got[i].prediction_correct is None for i in range(3, 6))
    st.compact_builds(spark, root, str(tmp_path / "compact"))
    assert st.current_builds(spark, str(tmp_path / "compact")).count() == 6


def test_latest_events_over_batches(spark, tmp_path):
    ddl = st.schemas.BUILD_EVENT
    src = tmp_path / "in"
    src.mkdir()
    events = spark.readStream.schema(ddl).json(str(src))
    for k in range(3):
        rows = [("j", 10 * k + i, "SUCCESS", 1, f"2024-01-0{k + 1}T00:00:0{i}", "", "", False) for i in range(5)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(src))
        q = st.keep_latest(events, str(tmp_path / "top"), str(tmp_path / "cp"), n=7)
        q.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/top/2").collect()
    assert sorted(r.build_number for r in last) == [13, 14, 20, 21, 22, 23, 24]


def test_mining_a_stream_equals_mining_at_once(spark, tmp_path):
    lines = [f"{'INFO' if i % 3 else 'WARN'} [svc-{i % 4}] {'Build' if i % 2 else 'Deploy'} started for branch b{chr(97 + i % 5)}" for i in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos long, raw string")
    src, ddl = tmp_path / "in", "pos long, raw string"
    for lo in (0, 20):
        df.where((F.col("pos") >= lo) & (F.col("pos") < lo + 20)).coalesce(1).write.mode("append").json(str(src))
        st.mine_lines(spark.readStream.schema(ddl).json(str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.pos: (r.event_id, r.template_online) for r in spark.read.parquet(f"{tmp_path}/out/lines").collect()}
    want = {r.pos: (r.event_id, r.template_online) for r in tm.mine(df).lines.collect()}
    assert got == want


def lines_of(n):
    return [f"{'INFO' if i % 3 else 'WARN'} [svc-{i % 4}] {'Build' if i % 2 else 'Deploy'} {'started' if i < n // 2 else 'ended'} for branch b{i % 5}" for i in range(n)]


def mined_at_once(spark, df):
    return {r.pos: (r.event_id, r.template_online) for r in tm.mine(df).lines.collect()}


def test_mining_lines_out_of_order(spark, tmp_path):
    """Four batches in odd orders, one of them run twice, with a restart after each; then a line that is too late."""
    df = spark.createDataFrame(list(enumerate(lines_of(60))), "pos long, raw string")
    lots = [range(12, 30), [*range(0, 12), *range(40, 45)], range(30, 40), range(45, 60)]
    src, out, ddl = str(tmp_path / "in"), str(tmp_path / "out"), "pos long, raw string"

    def run():
        q = st.mine_lines(st.read_json(spark, src, ddl), out, str(tmp_path / "cp"), lag=32)
        q.awaitTermination()
        return q.lastProgress["batchId"]

    for k, lot in enumerate(lots):
        part = df.where(F.col("pos").isin(list(lot)))
        part.coalesce(1).write.mode("append").json(src)
        assert run() == k
        if k == 2:  # as after a failure before the batch was committed
            st.mine_batch(part, k, out, lag=32)
    want = mined_at_once(spark, df)
    got = {r.pos: (r.event_id, r.template_online) for r in st.mined_lines(spark, out, 3).collect()}
    assert got == want
    done = {r.pos: (r.event_id, r.template_online) for r in spark.read.parquet(f"{out}/lines").select("pos", "event_id", "template_online").collect()}
    assert done == {p: t for p, t in want.items() if p <= 59 - 32}
    spark.createDataFrame([(3, "too late")], ddl).coalesce(1).write.mode("append").json(src)
    assert run() == 4
    assert [(r.pos, r.raw) for r in spark.read.parquet(f"{out}/late").select("pos", "raw").collect()] == [(3, "too late")]
    assert {r.pos: (r.event_id, r.template_online) for r in st.mined_lines(spark, out, 4).collect()} == want


def test_mining_starts_with_lines_that_wait(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(lines_of(10))), "pos long, raw string")
    out = str(tmp_path / "out")
    st.mine_batch(df.where("pos < 4"), 0, out, lag=100)
    st.mine_batch(df.limit(0), 1, out, lag=100)
    st.mine_batch(df.where("pos >= 4"), 2, out, lag=100)
    assert {r.pos: (r.event_id, r.template_online) for r in st.mined_lines(spark, out, 2).collect()} == mined_at_once(spark, df)


def test_repeated_events_over_many_batches(spark, tmp_path):
    """One file a batch; repeats within the watermark go, those without a time stay, late ones are dropped."""
    ddl = "job_name string, build_number long, status string, sent_at timestamp"
    lots = [
        [("a", 1, "X", "2024-01-01 10:00:00"), ("a", 1, "X", "2024-01-01 10:00:00"), ("b", 1, "X", None)],
        [("a", 1, "X", "2024-01-01 10:20:00"), ("a", 1, "Y", "2024-01-01 10:20:00"), ("b", 1, "X", None)],
        [("c", 9, "X", "2024-01-01 18:00:00")],
        [("d", 5, "X", "2024-01-01 18:01:00")],
        [("d", 5, "X", "2024-01-01 18:02:00"), ("e", 5, "X", "2024-01-01 10:00:00")],
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lot in lots:
        rows = spark.createDataFrame(lot, "job_name string, build_number long, status string, at string")
        rows.select("job_name", "build_number", "status", F.col("at").cast("timestamp").alias("sent_at")).coalesce(1).write.mode("append").json(src)
    events = st.once(st.read_json(spark, src, ddl, files_per_batch=1), ["job_name", "build_number", "status"], "sent_at")
    q = st.store(events, out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 5
    got = sorted((r.job_name, r.status) for r in spark.read.schema(ddl).parquet(out).collect())
    assert got == [("a", "X"), ("a", "Y"), ("b", "X"), ("b", "X"), ("c", "X"), ("d", "X")]
