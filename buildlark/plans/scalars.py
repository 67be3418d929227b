"""Queries for the scalar functions, run over every log line, text or build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlark.functions import logtext, scoring, times
from buildlark.plans import views
from buildlark.plans.registry import query
from buildlark.plans.views import with_views
from buildlark.session import settle

# DuckDB texts of the shared steps.
_SERVICE = r"nullif(regexp_extract(raw, '\[([A-Za-z][\w\-\.]{1,63})\]', 1), '')"
_WORD = (
    r"upper(regexp_extract(raw, '(?i)\b(DEBUG|INFO|WARNING|WARN|ERROR|ERR|FATAL|CRITICAL|CRIT"
    r"|PANIC|EXCEPTION|TIMEOUT)\b', 1))"
)
_LEVEL = (
    f"CASE {_WORD} WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' "
    "WHEN 'PANIC' THEN 'ERROR' WHEN 'EXCEPTION' THEN 'ERROR' WHEN 'TIMEOUT' THEN 'ERROR' "
    f"WHEN '' THEN 'UNKNOWN' ELSE {_WORD} END"
)
_SEVERITY = (
    "CASE lvl WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'ERROR' THEN 4 "
    "WHEN 'FATAL' THEN 5 WHEN 'CRITICAL' THEN 5 ELSE 0 END"
)


def sql_mask(col: str) -> str:
    out = col
    for p in logtext.MASK_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '<*>', 'g')"
    return out


def sql_tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array({col}, '\s+'), lambda t: t <> '')"


def sql_tfidf_text(col: str) -> str:
    out = f"lower({col})"
    for p, marker in logtext.TFIDF_MARKERS:
        out = f"regexp_replace({out}, '{p}', '{marker}', 'g')"
    return f"array_to_string(regexp_extract_all({out}, '{logtext.TFIDF_TOKEN}'), ' ')"


def sql_sequence_tokens(col: str) -> str:
    out = f"lower({col})"
    for p, marker in logtext.SEQUENCE_MARKERS:
        out = f"regexp_replace({out}, '{p}', '{marker}', 'g')"
    return f"regexp_extract_all({out}, '{logtext.SEQUENCE_TOKEN}')"


def _on_lines(name: str, cols: dict[str, tuple[Callable[[Column], Column], str]]) -> None:
    """Register a query giving each line's id and some functions of it."""
    sql = ", ".join(f"{text} AS {c}" for c, (_, text) in cols.items())

    @query(name, with_views(f"SELECT event_id, {sql} FROM event_logs"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        line = F.col("raw")
        return views.event_logs(spark, sf).select(
            "event_id", *[fn(line).alias(c) for c, (fn, _) in cols.items()]
        )


def _joined(arr: Column) -> Column:
    return F.array_join(arr, " ")


_on_lines("fn1_extract_level", {"lvl": (logtext.level, _LEVEL)})
_on_lines("fn2_extract_service", {"service": (logtext.service, _SERVICE)})
_on_lines("fn3_parse_timestamp", {"epoch": (
    lambda r: F.unix_micros(logtext.timestamp(r)),
    r"epoch_us(try_strptime(regexp_extract(raw, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'), '%Y-%m-%d %H:%M:%S'))",
)})
_on_lines("fn4_mask", {"masked": (logtext.mask, sql_mask("raw"))})
_on_lines("fn5_tokens", {
    "n_tokens": (lambda r: F.size(logtext.tokens(r)), f"cast(len({sql_tokens('raw')}) AS integer)"),
    "toks": (lambda r: F.array_join(logtext.tokens(r), "|"), f"array_to_string({sql_tokens('raw')}, '|')"),
})
_on_lines("fn6_branch_keys", {"branch_keys": (
    lambda r: _joined(F.transform(logtext.tokens(r), logtext.branch_key)),
    f"array_to_string(list_transform({sql_tokens('raw')}, "
    "lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')",
)})


@query("fn7_token_similarity", with_views(rf"""
SELECT event_id, sim, wild FROM (
  SELECT event_id, s, t,
    cast(len(list_filter(range(1, len(s) + 1), lambda i: s[i] = t[i] AND t[i] <> '<*>')) AS double) / len(s) AS sim,
    cast(len(list_filter(t, lambda x: x = '<*>')) AS integer) AS wild
  FROM (SELECT event_id, {sql_tokens(sql_mask('raw'))} AS s, {sql_tokens(sql_mask('msg'))} AS m FROM event_logs),
       LATERAL (SELECT list_concat(['<*>-<*>-<*>', '<*>:<*>:<*>', 'INFO'], m[2:]) AS t))
"""))
def token_similarity(spark, sf):
    """Similarity of each line to the same line written at level INFO."""
    e = views.event_logs(spark, sf)
    toks = logtext.tokens(logtext.mask(F.col("raw")))
    lead = F.array(F.lit("<*>-<*>-<*>"), F.lit("<*>:<*>:<*>"), F.lit("INFO"))
    rest = logtext.tokens(logtext.mask(F.col("msg")))
    template = F.concat(lead, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))))
    pair = e.select("event_id", toks.alias("s"), template.alias("t"))
    return pair.select(
        "event_id", logtext.similarity(F.col("t"), F.col("s")).alias("sim"),
        logtext.wildcard_count(F.col("t")).alias("wild"),
    )


_NEXT_SQL = f"""
WITH toks AS (SELECT event_id, {sql_tokens(sql_mask('msg'))} AS t, {sql_tokens('msg')} AS s FROM event_logs)"""


def _masked_and_plain(spark, sf):
    return views.event_logs(spark, sf).select(
        "event_id",
        logtext.tokens(logtext.mask(F.col("msg"))).alias("t"),
        logtext.tokens(F.col("msg")).alias("s"),
    )


@query("fn8_generalise", with_views(_NEXT_SQL + """
SELECT event_id, array_to_string(list_transform(range(1, len(t) + 1),
    lambda i: CASE WHEN t[i] = s[i] THEN t[i] ELSE '<*>' END), ' ') AS template
FROM toks WHERE len(t) = len(s)"""))
def generalise(spark, sf):
    df = _masked_and_plain(spark, sf).where(F.size("t") == F.size("s"))
    return df.select("event_id", _joined(logtext.generalise(F.col("t"), F.col("s"))).alias("template"))


@query("fn9_parameters", with_views(_NEXT_SQL + """
SELECT event_id, CASE WHEN len(t) = len(s) THEN array_to_string(list_transform(
    list_filter(range(1, len(t) + 1), lambda i: t[i] = '<*>' AND s[i] <> '<*>'), lambda i: s[i]), ' ') ELSE '' END AS params
FROM toks"""))
def parameters(spark, sf):
    df = _masked_and_plain(spark, sf)
    return df.select("event_id", _joined(logtext.parameters(F.col("t"), F.col("s"))).alias("params"))


_on_lines("fn10_template_string", {
    "template": (
        lambda r: _joined(logtext.tokens(logtext.mask(r))),
        f"array_to_string({sql_tokens(sql_mask('raw'))}, ' ')",
    ),
    "event_code": (
        lambda r: logtext.event_id(F.col("event_id")),
        "'E' || lpad(cast(event_id AS varchar), cast(greatest(5, len(cast(event_id AS varchar))) AS integer), '0')",
    ),
})


@query("fn11_severity", with_views(f"SELECT event_id, {_SEVERITY} AS severity FROM (SELECT event_id, {_LEVEL} AS lvl FROM event_logs)"))
def severity(spark, sf):
    return views.event_logs(spark, sf).select(
        "event_id", logtext.severity(logtext.level(F.col("raw"))).alias("severity")
    )


@query("fn12_numeric_features", with_views(rf"""
SELECT event_id, {_SEVERITY} / 5.0e0 AS level_severity, least(length(raw), 500) / 500.0e0 AS msg_length,
  least(len(s), 20) / 20.0e0 AS num_params,
  CASE WHEN regexp_matches(raw, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}') THEN 1.0e0 ELSE 0.0e0 END AS has_timestamp
FROM (SELECT event_id, raw, {_LEVEL} AS lvl, {sql_tokens('raw')} AS s FROM event_logs)"""))
def numeric_features(spark, sf):
    """The numeric features, with all tokens standing in for the parameters."""
    line = F.col("raw")
    feats = logtext.numeric_features(
        line, logtext.level(line), logtext.tokens(line), logtext.timestamp(line)
    )
    return views.event_logs(spark, sf).select("event_id", *[c.alias(n) for n, c in feats.items()])


_on_lines("fn13_tfidf_text", {"norm": (logtext.tfidf_text, sql_tfidf_text("raw"))})
_on_lines("fn14_sequence_tokens", {"toks": (
    lambda r: _joined(logtext.sequence_tokens(r)), f"array_to_string({sql_sequence_tokens('raw')}, ' ')",
)})
@query("fn15_error_matches", with_views(f"SELECT event_id, cast({views.sql_error_matches('raw')} AS integer) AS n_matches FROM event_logs"))
def error_matches(spark, sf):
    return logtext.count_error_matches(views.event_logs(spark, sf), "raw").select("event_id", "n_matches")


@query("fn16_unigrams_bigrams", with_views(rf"""
SELECT event_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS terms
FROM (SELECT event_id, regexp_extract_all({sql_tfidf_text('raw')}, '\b\w\w+\b') AS w FROM event_logs)"""))
def unigrams_bigrams(spark, sf):
    from buildlark.operators.features import with_terms

    lines = with_terms(views.event_logs(spark, sf).select("event_id", "raw"), "raw", "t")
    return lines.select("event_id", F.array_join("t", "|").alias("terms"))


@query("fn17_truncate", """
SELECT doc_id, md5(left(text, 500)) AS head500, md5(left(text, 2000)) AS head2000, md5(right(text, 2048)) AS tail2048
FROM documents""")
def truncate(spark, sf):
    t = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(logtext.head(t, scoring.SNIPPET_CHARS)).alias("head500"),
        F.md5(logtext.head(t, scoring.BUILD_LOG_CHARS)).alias("head2000"),
        F.md5(logtext.tail(t, scoring.CONSOLE_TAIL_CHARS)).alias("tail2048"),
    )


@query("fn18_slug", with_views("""
SELECT job_name, build_number, replace(lower(job_name), ' ', '_') AS slug, replace(job_name, '-', ' ') AS spaced FROM builds"""))
def slug(spark, sf):
    j = F.col("job_name")
    return views.builds(spark, sf).select(
        "job_name", "build_number", logtext.slug(j).alias("slug"), logtext.spaced(j).alias("spaced")
    )


@query("fn19_parse_iso", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS epoch FROM events""")
def parse_iso(spark, sf):
    """ISO text of each event back to a time; every fifth text is damaged and gives NULL."""
    e = views.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not "), text)).otherwise(text)
    return e.select("event_id", F.unix_micros(times.parse_iso(text)).alias("epoch"))


@query("fn20_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS epoch FROM events")
def epoch_ms(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return views.table(spark, sf, "events").select(
        "event_id", F.unix_micros(times.from_epoch_ms(ms)).alias("epoch")
    )


@query("fn21_time_formats", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%a') AS weekday,
  strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events""")
def time_formats(spark, sf):
    ts = F.col("ts")
    return views.table(spark, sf, "events").select(
        "event_id", times.day_key(ts).alias("day"), times.weekday(ts).alias("weekday"),
        times.run_id(ts).alias("run_id"), times.iso(ts).alias("iso"),
    )


@query("fn22_time_differences", with_views("""
SELECT prediction_id, line, (epoch_us(resolved_at) - epoch_us(created_at)) / 3600000000.0e0 AS hours,
  (epoch_us(resolved_at) - epoch_us(created_at)) / 1000000.0e0 AS seconds FROM alerts"""))
def time_differences(spark, sf):
    b, a = F.col("resolved_at"), F.col("created_at")
    return views.alerts(spark, sf).select(
        "prediction_id", "line", times.hours_between(b, a).alias("hours"),
        times.seconds_between(b, a).alias("seconds"),
    )


@query("fn25_threshold", with_views("SELECT doc_id, cast(score > 1000 AS integer) AS predicted FROM scored"))
def threshold(spark, sf):
    return views.scored(spark, sf).select("doc_id", scoring.above(F.col("score"), 1000.0).alias("predicted"))


_REC = scoring.RECOMMENDATIONS


@query("fn26_combined_risk", with_views(f"""
SELECT id, raw_risk, round(raw_risk, 2) AS risk_score, risk_level,
  CASE risk_level WHEN 'HIGH' THEN '{_REC['HIGH']}' WHEN 'MEDIUM' THEN '{_REC['MEDIUM']}' ELSE '{_REC['LOW']}' END AS recommendation
FROM (SELECT id, raw_risk, CASE WHEN raw_risk > 0.7e0 THEN 'HIGH' WHEN raw_risk > 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM (SELECT id, confidence * 0.6e0 + CASE WHEN id % 7 > 3 THEN 0.4e0 ELSE 0.0e0 END AS raw_risk FROM verdicts))"""))
def combined_risk(spark, sf):
    """Risk with a per-line forecast of id % 7 failures."""
    p = views.predictions(spark, sf)
    raw_risk = scoring.raw_risk(F.col("confidence"), F.col("id") % 7)
    scored = p.select("id", raw_risk.alias("raw_risk"))
    level = scoring.risk_level(F.col("raw_risk"))
    return scored.select(
        "id", "raw_risk", F.round("raw_risk", 2).alias("risk_score"), level.alias("risk_level"),
        scoring.recommendation(level).alias("recommendation"),
    )


@query("fn27_alert_severity", with_views("""
SELECT id, risk_level, CASE risk_level WHEN 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END AS severity
FROM predictions WHERE risk_level IN ('HIGH', 'MEDIUM')"""))
def alert_severity(spark, sf):
    # Stored first: a filter on a fresh verdict would be pushed below it and judge every line twice.
    stored = settle(views.predictions(spark, sf).select("id", "risk_level"), "predictions")
    sev = scoring.alert_severity(F.col("risk_level"))
    return stored.select("id", "risk_level", sev.alias("severity")).where("severity IS NOT NULL")


@query("fn28_keyword_verdict", with_views("""
SELECT id, n_matches, is_anomaly, anomaly_score, confidence,
  'Keyword fallback — ' || cast(n_matches AS varchar) || ' error pattern(s) matched' AS reason FROM verdicts"""))
def keyword_verdict(spark, sf):
    lines = views.event_logs(spark, sf).select(F.col("event_id").alias("id"), "raw")
    return scoring.keyword_verdict(lines, "raw").select(
        "id", "n_matches", "is_anomaly", "anomaly_score", "confidence", "reason"
    )


@query("fn29_json_arrays", """
SELECT p_partkey, point, CASE point WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END AS feature,
  CASE point WHEN 0 THEN cast(p_size AS double) WHEN 1 THEN p_size / 2.0e0 ELSE p_size / 4.0e0 END AS importance
FROM part, (SELECT unnest([0, 1, 2]) AS point)""")
def json_arrays(spark, sf):
    """Feature names and importances read back out of a JSON column."""
    p = views.table(spark, sf, "part")
    size = F.col("p_size").cast("double")
    doc = F.to_json(F.struct(
        F.array("p_brand", "p_type", "p_name").alias("features"),
        F.array(size, size / 2, size / 4).alias("importance"),
    ))
    read = F.from_json(F.col("doc"), "features array<string>, importance array<double>")
    rows = p.select("p_partkey", doc.alias("doc")).select("p_partkey", read.alias("r"))
    zipped = F.arrays_zip(F.col("r.features").alias("feature"), F.col("r.importance").alias("importance"))
    return rows.select("p_partkey", F.posexplode(zipped).alias("point", "z")).select(
        "p_partkey", "point", F.col("z.feature").alias("feature"), F.col("z.importance").alias("importance")
    )


@query("fn30_f1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount + l_tax = 0 THEN 0.0e0 ELSE 2.0e0 * l_discount * l_tax / (l_discount + l_tax) END AS f1 FROM lineitem""")
def f1(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        scoring.f1(F.col("l_discount"), F.col("l_tax")).alias("f1"),
    )


@query("fn31_zip_points", """
SELECT vec_id, i - 1 AS point, cast(embedding[i] AS double) AS fpr, cast(embedding[i] AS double) * 2 AS tpr
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def zip_points(spark, sf):
    from buildlark.operators.curves import zip_points as points

    v = views.table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("fpr"),
        F.transform("embedding", lambda x: x.cast("double") * 2).alias("tpr"),
    )
    return points(v, "fpr", "tpr").withColumn("point", F.col("point").cast("bigint"))
