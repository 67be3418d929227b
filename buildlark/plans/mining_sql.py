"""DuckDB text of template mining, for the queries that mine.

It goes from step to step: under the templates a leaf has, the next line that starts or generalises
one is the first later line for which that holds; lines between two steps change nothing.
"""

from __future__ import annotations

from buildlark.operators.templates import DEPTH, MAX_CHILDREN, SIMILARITY
from buildlark.plans.scalars import sql_mask, sql_tokens

# Of the most similar template: its score is packed as (matches * (tokens + 1) + wildcards) * _PACK - number.
_PACK = 1_000_000


def _top(templates: str, tokens: str) -> str:
    return f"""list_max(list_transform(range(1, len({templates}) + 1), lambda i: (
      len(list_filter(range(1, len({tokens}) + 1), lambda j: {templates}[i][j] = {tokens}[j] AND {tokens}[j] <> '<*>')) * (len({tokens}) + 1)
      + len(list_filter({templates}[i], lambda x: x = '<*>'))) * {_PACK} - i))"""


def _close(top: str, tokens: str) -> str:
    """The number of the template packed in ``top``, NULL if it is not similar enough."""
    score = f"(({top} + {_PACK - 1}) // {_PACK})"
    return f"CASE WHEN {score} // (len({tokens}) + 1) / len({tokens}) >= {SIMILARITY}e0 THEN {score} * {_PACK} - {top} END"


def sql_mined(text: str) -> str:
    """CTEs that end in ``mined`` (pos, event_id, template_online, template, t) of the event log's ``text``."""
    assert DEPTH == 4, "two levels of branch keys are spelt out below"

    def level(k: int, source: str, node: str) -> str:
        key = f"CASE WHEN regexp_matches(t[{k}], '[0-9]') THEN '<*>' ELSE t[{k}] END"
        return f"""
key{k} AS (SELECT *, {key} AS key, {node} AS node FROM {source}),
own{k} AS (SELECT node, key FROM (SELECT node, key, row_number() OVER (PARTITION BY node ORDER BY min(pos), key) AS r
    FROM key{k} WHERE key IS NOT NULL GROUP BY node, key) WHERE r <= {MAX_CHILDREN}),
leaf{k} AS (SELECT x.pos, x.t, CASE WHEN x.key IS NULL THEN x.node ELSE x.node || chr(31) || coalesce(o.key, '<*>') END AS leaf
  FROM key{k} x LEFT JOIN own{k} o ON o.node = x.node AND o.key = x.key)"""

    return f"""
masked_lines AS (SELECT event_id AS pos, CASE WHEN len(t) = 0 THEN ['<*>'] ELSE t END AS t
  FROM (SELECT event_id, {sql_tokens(sql_mask(text))} AS t FROM event_logs)),{level(1, 'masked_lines', 'cast(len(t) AS varchar)')},{level(2, 'leaf1', 'leaf')},
distinct_lines AS (SELECT leaf, t, list(pos ORDER BY pos) AS at FROM leaf2 GROUP BY leaf, t),
steps AS (
  WITH RECURSIVE run AS (
    SELECT leaf, cast(NULL AS bigint) AS pos, cast([] AS varchar[][]) AS s, cast(NULL AS bigint) AS cluster, false AS starts
    FROM (SELECT DISTINCT leaf FROM leaf2)
    UNION ALL
    SELECT leaf, pos, CASE WHEN best IS NULL THEN list_append(s, t) ELSE list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i <> best THEN s[i]
        ELSE list_transform(range(1, len(t) + 1), lambda j: CASE WHEN s[i][j] = t[j] THEN t[j] ELSE '<*>' END) END) END,
      coalesce(best, len(s) + 1), best IS NULL
    FROM (SELECT leaf, min(next_pos) AS pos, arg_min(t, next_pos) AS t, any_value(s) AS s,
            nullif(arg_min(coalesce(best, 0), next_pos), 0) AS best
      FROM (SELECT *, {_close('top', 't')} AS best FROM (
        SELECT r.leaf, r.s, d.t, list_min(list_filter(d.at, lambda p: r.pos IS NULL OR p > r.pos)) AS next_pos, {_top('r.s', 'd.t')} AS top
        FROM run r JOIN distinct_lines d ON d.leaf = r.leaf))
      WHERE next_pos IS NOT NULL AND (best IS NULL OR len(list_filter(range(1, len(t) + 1), lambda j: s[best][j] <> t[j] AND s[best][j] <> '<*>')) > 0)
      GROUP BY leaf)
  ) SELECT * FROM run),
state AS (SELECT l.pos, l.leaf, l.t, s.s, s.pos = l.pos AS is_step, s.cluster FROM leaf2 l ASOF JOIN (SELECT * FROM steps WHERE pos IS NOT NULL) s
  ON s.leaf = l.leaf AND s.pos <= l.pos),
joined AS (SELECT pos, leaf, t, s, CASE WHEN is_step THEN cluster ELSE {_close('top', 't')} END AS cluster FROM (SELECT *, {_top('s', 't')} AS top FROM state)),
numbered AS (SELECT leaf, cluster, 'E' || lpad(cast(row_number() OVER (ORDER BY pos) - 1 AS varchar), 5, '0') AS event_id, pos AS first_pos FROM steps WHERE starts),
last_state AS (SELECT leaf, arg_max(s, pos) AS s FROM steps WHERE pos IS NOT NULL GROUP BY leaf),
mined AS (SELECT j.pos, n.event_id, array_to_string(j.s[j.cluster], ' ') AS template_online, array_to_string(f.s[j.cluster], ' ') AS template, j.t, n.first_pos, j.s[j.cluster] AS template_tokens
  FROM joined j JOIN numbered n ON n.leaf = j.leaf AND n.cluster = j.cluster JOIN last_state f ON f.leaf = j.leaf)"""
