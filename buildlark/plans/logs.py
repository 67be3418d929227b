"""Queries for template mining, features and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlark.functions import logtext
from buildlark.operators import features as FT
from buildlark.operators import ordering
from buildlark.operators import rollups as R
from buildlark.operators import sequences as S
from buildlark.operators import templates as TM
from buildlark.plans import views
from buildlark.plans.mining_sql import sql_mined
from buildlark.plans.registry import query
from buildlark.plans.scalars import sql_mask, sql_sequence_tokens, sql_tfidf_text, sql_tokens
from buildlark.plans.views import with_views

_MASKED = f"array_to_string({sql_tokens(sql_mask('msg'))}, ' ')"


def _lines(spark, sf, text: str = "msg"):
    """(pos, raw) of the event log."""
    return views.event_logs(spark, sf).select(F.col("event_id").alias("pos"), F.col(text).alias("raw"))


def _masked(spark, sf):
    return _lines(spark, sf).withColumn("masked", TM.masked_line(F.col("raw")))


# --- templates -------------------------------------------------------------------
@query("win4_event_numbers", with_views(f"""
SELECT masked, first_pos, 'E' || lpad(cast(row_number() OVER (ORDER BY first_pos) - 1 AS varchar), 5, '0') AS event_id
FROM (SELECT {_MASKED} AS masked, min(event_id) AS first_pos FROM event_logs GROUP BY 1)"""))
def event_numbers(spark, sf):
    seen = _masked(spark, sf).groupBy("masked").agg(F.min("pos").alias("first_pos"))
    numbered = ordering.number_globally(seen, "first_pos", "no")
    return numbered.select("masked", "first_pos", logtext.event_id(F.col("no") - 1).alias("event_id"))


@query("win5_first_branch_keys", with_views(rf"""
SELECT node, key, first_pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY first_pos, key) AS r FROM (
  SELECT cast(len(t) AS varchar) AS node, CASE WHEN regexp_matches(t[2], '[0-9]') THEN '<*>' ELSE t[2] END AS key, min(event_id) AS first_pos
  FROM (SELECT event_id, regexp_split_to_array(regexp_replace(msg, 'svc-1[0-4]', 'svc-x', 'g'), '[ -]') AS t FROM event_logs) GROUP BY 1, 2))
WHERE r <= 100"""))
def first_branch_keys(spark, sf):
    """The first hundred branch keys per token count, on the second token of lines cut at blanks and dashes."""
    text = F.regexp_replace("raw", "svc-1[0-4]", "svc-x")
    t = F.split(text, "[ -]")
    keyed = _lines(spark, sf).select(
        "pos", F.size(t).cast("string").alias("node"), logtext.branch_key(F.get(t, F.lit(1))).alias("key")
    )
    return TM.first_keys(keyed, "node", "key", "pos", TM.MAX_CHILDREN)


@query("min1_mine_templates", with_views(f"WITH {sql_mined('raw')} SELECT pos, event_id, template_online, template FROM mined"))
def mine_templates(spark, sf):
    """Event id and template of every stamped line."""
    return TM.mine(_lines(spark, sf, "raw")).lines.select("pos", "event_id", "template_online", "template")


@query("min1_mine_templates_unstamped", with_views(f"WITH {sql_mined('msg')} SELECT pos, event_id, template_online, template FROM mined"))
def mine_unstamped(spark, sf):
    """The same with the time stamps taken off first."""
    mined = TM.mine(_lines(spark, sf, "raw"), strip_timestamp=True)
    return mined.lines.select("pos", "event_id", "template_online", "template")


@query("min2_parse_batch", with_views(rf"""
WITH {sql_mined('raw')},
timed AS (SELECT *, epoch_us(date_trunc('second', ts)) AS us FROM event_logs)
SELECT m.pos, e.job, e.raw, m.template_online AS template, m.template AS final_template, m.event_id,
  array_to_string(list_transform(list_filter(range(1, len(m.t) + 1), lambda i: m.template_tokens[i] = '<*>' AND m.t[i] <> '<*>'), lambda i: m.t[i]), ' ') AS parameters,
  CASE split_part(e.msg, ' ', 1) WHEN 'WARN' THEN 'WARNING' ELSE split_part(e.msg, ' ', 1) END AS log_level,
  nullif(regexp_extract(e.raw, '\[([A-Za-z][\w\-\.]{{1,63}})\]', 1), '') AS service, e.us AS timestamp,
  (e.us - lag(e.us) OVER (PARTITION BY e.job ORDER BY m.pos)) / 1000000.0e0 AS timestamp_delta_sec
FROM mined m JOIN timed e ON e.event_id = m.pos"""))
def parse_batch(spark, sf):
    lines = views.event_logs(spark, sf).select(F.col("event_id").alias("pos"), F.col("raw"), "job")
    recs = TM.parse_batch(lines, source="job")
    return recs.withColumn("parameters", F.array_join("parameters", " ")).withColumn("timestamp", F.unix_micros("timestamp"))


@query("min3_assign_templates", with_views(f"""
WITH m AS (SELECT event_id AS pos, msg, {sql_tokens(sql_mask('msg'))} AS t FROM event_logs),
stored AS (SELECT array_to_string(t, ' ') AS template, any_value(t) AS t, min(pos) AS first_pos FROM m WHERE NOT starts_with(msg, 'INFO') GROUP BY 1),
lines AS (SELECT DISTINCT array_to_string(t, ' ') AS masked, t FROM m),
pairs AS (SELECT l.masked, s.template, s.first_pos,
    len(list_filter(range(1, len(l.t) + 1), lambda i: l.t[i] = s.t[i] AND s.t[i] <> '<*>')) / len(l.t) AS sim,
    len(list_filter(s.t, lambda x: x = '<*>')) AS wild
  FROM lines l JOIN stored s ON len(l.t) = len(s.t) AND l.t[1] = s.t[1] AND l.t[2] = s.t[2]),
best AS (SELECT masked, arg_max(template, (sim, wild, -first_pos)) AS template, max(sim) AS sim FROM pairs GROUP BY 1)
SELECT pos, coalesce(CASE WHEN b.sim >= 0.4 THEN b.template END, '__OTHER__') AS event_id
FROM m LEFT JOIN best b ON array_to_string(m.t, ' ') = b.masked"""))
def assign_templates(spark, sf):
    """All lines against the masked lines that are not INFO, taken as the stored templates."""
    masked = _masked(spark, sf)
    stored = masked.where("raw NOT LIKE 'INFO%'").groupBy("masked").agg(F.min("pos").alias("pos"))
    routed, branches = TM.with_leaf(stored, TM.DEPTH, TM.MAX_CHILDREN)
    templates = routed.select("leaf", F.col("masked").alias("event_id"), F.col("masked").alias("template"), F.col("pos").alias("first_pos"))
    return TM.assign(masked, templates, branches).select("pos", "event_id")


@query("ag13_template_frequency", with_views(f"""
WITH {sql_mined('msg')},
top AS (SELECT event_id, any_value(template) AS template, count(*) AS count, min(first_pos) AS f FROM mined GROUP BY 1 ORDER BY count DESC, f LIMIT 25),
shown AS (SELECT m.event_id, m.pos, e.msg, row_number() OVER (PARTITION BY m.event_id ORDER BY m.pos) AS r FROM mined m JOIN event_logs e ON e.event_id = m.pos)
SELECT top.event_id, template, count, examples FROM top
JOIN (SELECT event_id, string_agg(msg, '|' ORDER BY pos) AS examples FROM shown WHERE r <= 3 GROUP BY 1) x ON x.event_id = top.event_id"""))
def template_frequency(spark, sf):
    lines = _lines(spark, sf)
    mined = TM.mine(lines)
    top = TM.summarise(mined.lines, mined.templates, lines, top_k=25)
    return top.withColumn("examples", F.array_join("examples", "|"))


@query("ag13_masked_line_frequency", with_views(f"""
WITH m AS (SELECT event_id AS pos, msg, {_MASKED} AS masked FROM event_logs),
top AS (SELECT masked, count(*) AS count, min(pos) AS f FROM m GROUP BY 1 ORDER BY count DESC, f LIMIT 25)
SELECT masked AS event_id, masked AS template, count, (
  SELECT string_agg(msg, '|' ORDER BY pos) FROM (SELECT pos, msg, row_number() OVER (PARTITION BY masked ORDER BY pos) AS r, masked AS k FROM m) x
  WHERE x.k = top.masked AND r <= 3) AS examples FROM top"""))
def masked_line_frequency(spark, sf):
    m = _masked(spark, sf).withColumn("event_id", F.col("masked"))
    templates = m.groupBy("event_id").agg(F.min("pos").alias("first_pos")).withColumn("template", F.col("event_id"))
    top = TM.summarise(m, templates, m, top_k=25)
    return top.withColumn("examples", F.array_join("examples", "|"))


@query("ag14_batch_summary", with_views(f"""
SELECT count(*) AS n_lines, count(DISTINCT masked) AS n_unique_templates FROM (SELECT {_MASKED} AS masked FROM event_logs)"""))
def batch_summary(spark, sf):
    return R.batch_summary(_masked(spark, sf).withColumnRenamed("masked", "event_id"))


# --- structured features -------------------------------------------------------------
_FEATURE_LINES = rf"""
feature_lines AS (SELECT event_id AS pos, msg, {_MASKED} AS ev, nullif(regexp_extract(msg, '\[([A-Za-z][\w\-\.]{{1,63}})\]', 1), '') AS service,
    CASE split_part(msg, ' ', 1) WHEN 'WARN' THEN 'WARNING' ELSE split_part(msg, ' ', 1) END AS lvl,
    len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '<*>' AND s[i] <> '<*>')) AS n_params
  FROM (SELECT *, {sql_tokens(sql_mask('msg'))} AS t, {sql_tokens('msg')} AS s FROM event_logs))"""


def _slots_sql(templates: int, services: int) -> str:
    return f"""{_FEATURE_LINES},
raw_slots AS (
  SELECT * FROM (SELECT 1 AS k, 'tmpl' AS kind, ev AS key, 0 AS l, count(*) AS n, min(pos) AS f FROM feature_lines GROUP BY ev ORDER BY n DESC, f LIMIT {templates})
  UNION ALL SELECT 1, 'tmpl', '__OTHER__', 1, 0, 0
  UNION ALL SELECT * FROM (SELECT 2, 'svc', coalesce(service, '__NONE__') AS s, 0, count(*) AS n, min(pos) AS f FROM feature_lines GROUP BY s ORDER BY n DESC, f LIMIT {services})
  UNION ALL SELECT 2, 'svc', '__OTHER__', 1, 0, 0
  UNION ALL SELECT 3, 'lvl', unnest(['DEBUG', 'INFO', 'WARNING', 'ERROR', 'FATAL', 'CRITICAL', 'UNKNOWN']), 0, 0, unnest(range(7))
  UNION ALL SELECT 4, 'num', unnest(['level_severity', 'msg_length', 'num_params', 'has_timestamp']), 0, 0, unnest(range(4))),
slots AS (SELECT kind, key, cast(row_number() OVER (ORDER BY k, l, n DESC, f) - 1 AS integer) AS idx FROM raw_slots),
placed AS (SELECT x.*, coalesce(t.idx, (SELECT idx FROM slots WHERE kind = 'tmpl' AND key = '__OTHER__')) AS tmpl_idx,
    coalesce(v.idx, (SELECT idx FROM slots WHERE kind = 'svc' AND key = '__OTHER__')) AS svc_idx, w.idx AS lvl_idx
  FROM feature_lines x LEFT JOIN slots t ON t.kind = 'tmpl' AND t.key = x.ev
  LEFT JOIN slots v ON v.kind = 'svc' AND v.key = coalesce(x.service, '__NONE__') JOIN slots w ON w.kind = 'lvl' AND w.key = x.lvl)"""


def _feature_lines(spark, sf):
    """Lines with everything the structured features need; the masked line is the event id."""
    raw = F.col("raw")
    base = _masked(spark, sf).select(
        "pos", "raw", F.col("masked").alias("event_id"), logtext.service(raw).alias("service"),
        logtext.level(raw).alias("log_level"),
        logtext.parameters(F.split("masked", " "), logtext.tokens(raw)).alias("params"),
    )
    nums = logtext.numeric_features(raw, F.col("log_level"), F.col("params"), logtext.timestamp(raw))
    return base.select("*", *[c.alias(n) for n, c in nums.items()])


@query("jn3_template_slots", with_views(f"WITH {_slots_sql(200, 32)} SELECT pos, tmpl_idx FROM placed"))
def template_slots(spark, sf):
    lines = _feature_lines(spark, sf)
    return FT.with_slots(lines, FT.slots(lines)).select("pos", "tmpl_idx")


@query("jn4_service_slots", with_views(f"WITH {_slots_sql(200, 32)} SELECT pos, svc_idx FROM placed"))
def service_slots(spark, sf):
    lines = _feature_lines(spark, sf)
    return FT.with_slots(lines, FT.slots(lines)).select("pos", "svc_idx")


@query("fea1_structured_features", with_views(f"""
WITH {_slots_sql(200, 32)},
num AS (SELECT min(idx) AS i FROM slots WHERE kind = 'num'),
sev AS (SELECT *, CASE lvl WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 ELSE 0 END / 5.0e0 AS s FROM placed)
SELECT pos, tmpl_idx AS col, 1.0e0 AS value FROM sev UNION ALL SELECT pos, svc_idx, 1.0e0 FROM sev UNION ALL SELECT pos, lvl_idx, 1.0e0 FROM sev
UNION ALL SELECT pos, i, s FROM sev, num WHERE s <> 0 UNION ALL SELECT pos, i + 1, least(length(msg), 500) / 500.0e0 FROM sev, num
UNION ALL SELECT pos, i + 2, least(n_params, 20) / 20.0e0 FROM sev, num WHERE n_params > 0"""))
def structured_features(spark, sf):
    lines = _feature_lines(spark, sf)
    return FT.structured_long(lines, FT.slots(lines), "pos")


@query("fea2_feature_names", with_views(f"WITH {_slots_sql(200, 32)} SELECT idx, kind || '::' || key AS name FROM slots"))
def feature_names(spark, sf):
    return FT.slots(_feature_lines(spark, sf)).select("idx", "name")


# --- TF-IDF ------------------------------------------------------------------------------
def _terms_sql(text: str, key: str, source: str, limit: int) -> str:
    return rf"""
words AS (SELECT {key} AS id, regexp_extract_all({sql_tfidf_text(text)}, '\b\w\w+\b') AS w FROM {source}),
terms AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
kept AS (SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM terms GROUP BY 1 ORDER BY cf DESC, term LIMIT {limit}),
vocab AS (SELECT term, cast(row_number() OVER (ORDER BY term) - 1 AS integer) AS idx, df,
  ln((1.0e0 + (SELECT count(*) FROM words)) / (1.0e0 + df)) + 1.0e0 AS idf FROM kept)"""


@query("fea3_tfidf", with_views(f"""
WITH {_terms_sql('msg', 'event_id', 'event_logs', 5000)},
w AS (SELECT id, idx, term, (1.0e0 + ln(count(*))) * any_value(idf) AS w FROM terms JOIN vocab USING (term) GROUP BY 1, 2, 3)
SELECT id, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS weight FROM w"""))
def tfidf(spark, sf):
    docs = views.event_logs(spark, sf).select(F.col("event_id").alias("id"), "msg")
    out = FT.tfidf_long(docs, "id", "msg", FT.vocabulary(docs, "msg"))
    return out.withColumn("weight", F.round("weight", 9))


@query("tk9_top_terms", with_views(f"""
WITH {_terms_sql('text', 'doc_id', 'documents', 5000)} SELECT term, idx, df, round(idf, 9) AS idf FROM vocab"""))
def top_terms(spark, sf):
    """The 5 000 most frequent terms of all documents."""
    docs = views.documents(spark, sf)
    return FT.vocabulary(docs, "text").withColumn("idf", F.round("idf", 9))


# --- sequences ----------------------------------------------------------------------------
def _vocab_sql(source: str, text: str, build: str, pos: str, min_freq: int = 1) -> str:
    return f"""
toks AS (SELECT {build} AS build, {pos} AS pos, {sql_sequence_tokens(text)} AS t FROM {source}),
flat AS (SELECT build, pos, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token FROM toks),
vocab AS (SELECT token, n, cast(row_number() OVER (ORDER BY f) + 1 AS integer) AS id FROM
  (SELECT token, count(*) AS n, min((build, pos, i)) AS f FROM flat GROUP BY 1 HAVING count(*) >= {min_freq}))"""


@query("ag16_token_vocabulary", with_views(f"WITH {_vocab_sql('conversations', 'text', 'conv_id', 'turn')} SELECT token, n, id FROM vocab"))
def token_vocabulary(spark, sf):
    return S.vocabulary(S.tokenised(views.build_lines(spark, sf)))


@query("jn2_token_ids", with_views(f"""
WITH {_vocab_sql('build_events', 'line', 'build', 'pos')} SELECT build, pos, i - 1 AS i, token, coalesce(id, 1) AS id FROM flat LEFT JOIN vocab USING (token)"""))
def token_ids(spark, sf):
    toks = S.tokenised(views.build_events(spark, sf))
    flat = toks.select("build", "pos", F.posexplode("toks").alias("i", "token"))
    out = S.token_ids(flat, S.vocabulary(toks))
    return out.select("build", "pos", F.col("i").cast("bigint").alias("i"), "token", "id")


@query("win6_leading_lines", with_views("""
SELECT build, array_to_string(list_concat(v, list_transform(range(20 - len(v)), lambda x: -1)), ' ') AS lens FROM (
  SELECT build, list(n ORDER BY pos) AS v FROM (SELECT build, pos, length(line) AS n, row_number() OVER (PARTITION BY build ORDER BY pos) AS r FROM build_lines) WHERE r <= 20 GROUP BY 1)"""))
def leading_lines(spark, sf):
    lines = views.build_lines(spark, sf).withColumn("n", F.length("line"))
    out = S.leading(lines, "n", 20, -1)
    return out.select("build", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("lens"))


@query("seq1_encode_builds", with_views(f"""
WITH {_vocab_sql('conversations', 'text', 'conv_id', 'turn')},
lead AS (SELECT build, row_number() OVER (PARTITION BY build ORDER BY pos) AS line_no, t[1:30] AS t FROM toks),
ids AS (SELECT build, line_no, list(coalesce(id, 1) ORDER BY i) AS v FROM
  (SELECT build, line_no, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token FROM lead WHERE line_no <= 20) LEFT JOIN vocab USING (token) GROUP BY 1, 2),
grid AS (SELECT build, unnest(range(1, 21)) AS line_no FROM (SELECT DISTINCT build FROM toks))
SELECT build, string_agg(array_to_string(list_concat(coalesce(v, []), list_transform(range(30 - len(coalesce(v, []))), lambda x: 0)), ' '), '|' ORDER BY line_no) AS ids
FROM grid LEFT JOIN ids USING (build, line_no) GROUP BY 1"""))
def encode_builds(spark, sf):
    toks = S.tokenised(views.build_lines(spark, sf))
    out = S.encode(toks, S.vocabulary(toks))
    lines = F.transform("ids", lambda l: F.array_join(F.transform(l, lambda x: x.cast("string")), " "))
    return out.select("build", F.array_join(lines, "|").alias("ids"))


@query("win9_escalation", with_views(f"""
WITH x AS (SELECT *, max(pos) OVER (PARTITION BY build) + 1 AS n_lines, {views.sql_error_matches('line')} AS e,
    CASE split_part(line, ' ', 1) WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 END AS sev FROM build_events),
p AS (SELECT *, least(4, cast(floor(pos * 5 / n_lines) AS integer)) AS ph FROM x)
SELECT build, max(n_lines) AS n_lines,
  {', '.join(f"coalesce(cast(sum(sev) FILTER (ph = {k}) AS double) / count(*) FILTER (ph = {k}), 0.0e0) AS sev_mean_{k}, coalesce(max(sev) FILTER (ph = {k}), 0) AS sev_max_{k}" for k in range(5))},
  count(*) FILTER (e > 0) AS errors, count(*) FILTER (e > 0 AND ph >= 3) AS late_errors,
  (coalesce(max(pos) FILTER (e > 0), -1) + 1) / max(n_lines) AS last_error_at,
  count(*) FILTER (sev = 3 AND ph >= 3) - count(*) FILTER (sev = 3 AND ph < 2) AS warn_rise
FROM p GROUP BY build"""))
def escalation(spark, sf):
    return S.escalation(views.build_events(spark, sf))
