"""Column functions on literal lines with known outcomes, and null semantics of the roll-ups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buildlark import schemas
from buildlark.functions import logtext as L
from buildlark.functions import scoring, times
from buildlark.operators import builds as B
from buildlark.operators import curves, features, metrics, rollups, tables
from buildlark.sources import payloads


def apply(spark, values, fn, ddl="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {ddl}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_levels(spark):
    lines = ["WARN low memory", "ERR something", "just some text", "crit x", "panic!", "a Timeout", "INFORMATION", "debug it", "Exception in x"]
    assert apply(spark, lines, L.level) == [
        "WARNING", "ERROR", "UNKNOWN", "CRITICAL", "ERROR", "ERROR", "UNKNOWN", "DEBUG", "ERROR"]


def test_service(spark):
    lines = ["INFO [auth-service] Build started", "no service", "[x] too short", "[9ab] digit first", "[a.b-c] ok [later]"]
    assert apply(spark, lines, L.service) == ["auth-service", None, None, None, "a.b-c"]


def test_timestamps(spark):
    lines = ["2024-01-02T03:04:05Z x", "2024-01-02T03:04:05.250+02:00", "2024-01-02T03:04:05+0230", "2024-01-02 03:04:05.5 y",
             "2024-01-02 03:04:05,123", "2024-01-02 03:04:05Z", "Jan  2 15:04:05 host", "Xyz 02 15:04:05", "2024-13-02 03:04:05", "none"]
    got = apply(spark, lines, lambda c: F.unix_micros(L.timestamp(c)))
    us = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert got == [us(2024, 1, 2, 3, 4, 5), us(2024, 1, 2, 1, 4, 5, 250000), us(2024, 1, 2, 0, 34, 5),
                   us(2024, 1, 2, 3, 4, 5, 500000), None, None, us(1900, 1, 2, 15, 4, 5), None, None, None]


def test_mask_and_tokens(spark):
    lines = ["took 30s and 87%", "from 10.0.0.1:8080 to 0xdeadbeef", "v1.2.3 of deadbeef99", "[svc-1] port 80", "  a \t b  "]
    assert apply(spark, lines, L.mask) == ["took <*> and <*>%", "from <*> to <*>", "<*> of <*>", "<*> port <*>", "  a \t b  "]
    assert apply(spark, lines[-1:], L.tokens) == [["a", "b"]]


def test_parameters_and_generalise(spark):
    df = spark.createDataFrame([(["a", "<*>", "<*>"], ["a", "x", "<*>"])], "t array<string>, s array<string>")
    r = df.select(L.parameters(F.col("t"), F.col("s")), L.similarity(F.col("t"), F.col("s")), L.generalise(F.col("s"), F.col("t"))).first()
    assert r[0] == ["x"] and r[1] == pytest.approx(1 / 3) and r[2] == ["a", "<*>", "<*>"]


def test_tfidf_text(spark):
    lines = ["port 8080 timeout 30", "connect to 192.168.1.1", "memory 0xdeadbeef", "", "Some_Name HERE"]
    assert apply(spark, lines, L.tfidf_text) == ["port <num> timeout <num>", "connect to <ip>", "memory <hex>", "", "some_name here"]


def test_sequence_tokens(spark):
    assert apply(spark, ["Port 8080 at 10.0.0.1 took 1.5 s"], L.sequence_tokens) == [["port", "<num>", "at", "<ip>", "took", "<num>", "s"]]


def test_terms(spark):
    df = spark.createDataFrame([(0, "alpha beta x beta"), (1, ""), (2, "one")], "i int, t string")
    got = {r.i: r.o for r in features.with_terms(df, "t", "o").collect()}
    assert got == {0: ["alpha", "beta", "beta", "alpha beta", "beta beta"], 1: [], 2: ["one"]}


def test_keyword_verdict(spark):
    lines = ["ERROR: database connection timeout.", "Build completed successfully. All tests passed.",
             "connection was refused\nnot\nfound", "not found, NOT FOUND", "ſyſtem craſh", None, "error " * 9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    got = {r.i: r for r in scoring.keyword_verdict(df, "t").collect()}
    assert [got[i].n_matches for i in range(7)] == [2, 0, 1, 1, 1, 0, 9]
    assert got[0].is_anomaly and not got[1].is_anomaly
    assert got[1].confidence == 0.85 and got[0].confidence == 0.7 and got[6].confidence == 0.9
    assert got[6].anomaly_score == -4.5 and got[1].anomaly_score == 0.0


def test_error_matches_equal_the_sixteen_patterns(spark):
    text = "Error ERROR fatal not so found disk is full; Connection timed out, then refused. permission denied OutOfMemory"
    regex = sum((F.regexp_count(F.col("t"), F.lit(f"(?iud){p}")) for p in L.ERROR_PATTERNS), F.lit(0))
    df = spark.createDataFrame([(text,), (text * 3,), ("fine",), ("İıſK errorerror",)], "t string")
    for r in L.count_error_matches(df.withColumn("want", regex), "t").collect():
        assert r.n_matches == r.want


def test_risk(spark):
    df = spark.createDataFrame([(0.85, 0), (0.6, 0), (0.7, 0), (0.7, 4), (0.9, 3)], "c double, f int")
    raw = scoring.raw_risk(F.col("c"), F.col("f"))
    got = [(r[0], r[1]) for r in df.select(scoring.risk_level(raw), scoring.alert_severity(scoring.risk_level(raw))).collect()]
    assert got == [("MEDIUM", "WARNING"), ("LOW", None), ("MEDIUM", "WARNING"), ("HIGH", "CRITICAL"), ("MEDIUM", "WARNING")]
    gated = scoring.raw_risk(F.lit(0.85), F.lit(0), F.lit(False))
    assert df.select(scoring.risk_level(gated)).first()[0] == "LOW"


def test_blob_lines(spark):
    blobs = ["a\n\n b \r\nc", " \n\t\n", "", "x\x1cy z"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b string")
    rows = sorted((r.i, r.pos, r.line) for r in payloads.blob_lines(df, "b", "i").collect())
    assert rows == [(0, 0, "a"), (0, 1, " b "), (0, 2, "c"), (1, 0, ""), (2, 0, ""), (3, 0, "x"), (3, 1, "y"), (3, 2, "z")]
    assert apply(spark, blobs, L.first_line) == ["a", "", None, "x"]


def test_iso_times(spark):
    got = apply(spark, ["2024-01-01T00:00:00", "2024-01-01T00:00:00.5", "nonsense", None], lambda c: times.iso(times.parse_iso(c)))
    assert got == ["2024-01-01T00:00:00", "2024-01-01T00:00:00.500000", None, None]


def test_contract(spark):
    bodies = ['{"pipeline_id": "a", "logs": "x"}', '{"logs": "x"}', '{"pipeline_id":', '{"pipeline_id": "b"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    out = payloads.validate(df, "body", schemas.CONTRACTS["prediction_request"]).orderBy("i").collect()
    assert [r.is_valid for r in out] == [True, False, False, True]


def test_build_counts_treat_null_as_no(spark):
    rows = [("j", "SUCCESS", None, False, None), ("j", "FAILURE", True, True, True), ("j", "FAILURE", None, True, False),
            ("j", "IN_PROGRESS", True, None, None), ("j", None, True, True, True), ("j", "ABORTED", False, True, False)]
    df = spark.createDataFrame(rows, "job_name string, status string, predicted_failure boolean, actual_failure boolean, prediction_correct boolean")
    c = B.comparison(df).first()
    assert (c.total_builds, c.actual_failures, c.predicted_failures, c.correct_predictions, c.false_positives, c.false_negatives) == (4, 3, 1, 1, 0, 2)
    assert c.accuracy == 0.25
    assert B.overview(df.withColumn("risk_level", F.lit("HIGH"))).first().total_builds == 6


def test_history_puts_unknown_times_first(spark):
    df = spark.createDataFrame([("j", 1, dt.datetime(2024, 1, 1)), ("j", 2, None), ("j", 3, dt.datetime(2024, 1, 2))], "job_name string, build_number int, build_timestamp timestamp")
    assert [r.build_number for r in B.history(df, "j", 3).collect()] == [2, 3, 1]


def test_weekday_trend_is_zero_filled(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), True), (dt.datetime(2024, 1, 1), False), (dt.datetime(2023, 1, 3), True)], "created_at timestamp, is_anomaly boolean")
    got = rollups.weekday_trend(df, F.lit(dt.datetime(2024, 1, 2)))
    assert [(r.date, r["count"]) for r in got.collect()] == [("Mon", 1)] + [(d, 0) for d in times.WEEKDAYS[1:]]


def test_hourly_gaps_are_filled(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 5), True), ("a", dt.datetime(2024, 1, 1, 3, 5), False)], "s string, t timestamp, f boolean")
    got = sorted((r.hour.hour, r.failures) for r in rollups.hourly_failures(df, "s", "t", F.col("f")).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 0)]


def test_constant_scores_scale_to_a_half(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "s double")
    assert [r.o for r in metrics.min_max(df, "s", "o").collect()] == [0.5, 0.5]


def test_empty_inputs_give_empty_or_zero_results(spark):
    none = spark.createDataFrame([], "label int, score double")
    assert curves.auc(none).first().auc is None
    assert rollups.accuracy_trend(spark.createDataFrame([], "predicted_at timestamp, predicted_anomaly boolean, actual_anomaly boolean")).count() == 0


def test_upsert_keeps_first_url_and_latest_rest(spark):
    def row(n, status, url, day, snippet="x"):
        return (n, "j", 1, status, 5, url, snippet, False, None, None, None, None, None, None, None, None, dt.datetime(2024, 1, day))
    ddl = schemas.TABLES["builds"]
    stored = spark.createDataFrame([row(1, "IN_PROGRESS", "u1", 1)], ddl)
    new = spark.createDataFrame([row(2, "SUCCESS", "u3", 3), row(3, "ABORTED", "u2", 2)], ddl)
    got = tables.upsert_builds(stored, new).collect()
    assert len(got) == 1 and got[0].status == "SUCCESS" and got[0].build_url == "u1"
    assert tables.upsert_builds(stored.limit(0), new).first().build_url == "u2"
