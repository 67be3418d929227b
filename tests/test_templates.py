"""Template mining against a plain one-line-at-a-time implementation."""

import random

import pytest
from pyspark.sql import functions as F

from buildlark.operators import templates as tm

W = "<*>"


def one_by_one(masked, depth=4, sim=0.4, max_children=100):
    """Reads lines in order; returns (cluster per line, text at that moment, final texts)."""
    branches, leaves, texts, out = {}, {}, [], []
    for line in masked:
        toks = line.split(" ")
        node = (len(toks),)
        for t in toks[: depth - 2]:
            key = W if any(c.isdigit() for c in t) else t
            seen = branches.setdefault(node, [])
            if key not in seen:
                if len(seen) < max_children:
                    seen.append(key)
                else:
                    key = W
            node += (key,)
        best = None
        for cid in leaves.setdefault(node, []):
            tpl = texts[cid]
            score = (sum(a == b != W for a, b in zip(tpl, toks)), sum(a == W for a in tpl))
            if best is None or score > best[0]:
                best = (score, cid)
        if best and best[0][0] / len(toks) >= sim:
            cid = best[1]
            texts[cid] = [a if a == b else W for a, b in zip(texts[cid], toks)]
        else:
            cid = len(texts)
            texts.append(toks)
            leaves[node].append(cid)
        out.append((cid, " ".join(texts[cid])))
    return out, [" ".join(t) for t in texts]


def lines_df(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos long, raw string")


def mined(spark, lines, **kw):
    m = tm.mine(lines_df(spark, lines), **kw)
    rows = sorted(m.lines.select("pos", "event_id", "template_online", "template").collect())
    return rows, {r.event_id: r.template for r in m.templates.collect()}, m


@pytest.mark.parametrize("seed,chunk,children", [(1, 7, 100), (2, 16, 3), (3, 400, 2), (4, 5, 5), (5, 50, 100)])
def test_same_as_one_by_one(spark, monkeypatch, seed, chunk, children):
    monkeypatch.setattr(tm, "FAN_IN", 3)
    monkeypatch.setattr(tm, "STEPS_PER_ROUND", 2 if seed == 4 else 4096)
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", W, "n1"]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 5, 6]))) for _ in range(240)]
    want, texts = one_by_one(lines, max_children=children)
    # "n1" is a token with a digit that no mask touches, so masking leaves these lines alone.
    rows, templates, _ = mined(spark, lines, chunk_lines=chunk, max_children=children)
    assert [(int(r.event_id[1:]), r.template_online) for r in rows] == want
    assert templates == {f"E{i:05d}": t for i, t in enumerate(texts)}


@pytest.mark.parametrize("kind", ["negative", "sparse", "hashed"])
def test_positions_of_any_kind(spark, kind):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", W]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.choice([4, 5]))) for _ in range(150)]
    at = {
        "negative": lambda: range(-75, 75),
        "sparse": lambda: range(0, 150 * 10**12, 10**12),
        "hashed": lambda: sorted(rnd.randrange(-2**63, 2**63) for _ in range(150)),
    }[kind]()
    df = spark.createDataFrame(list(zip(at, lines)), "pos long, raw string")
    want, texts = one_by_one(lines)
    m = tm.mine(df, chunk_lines=12)
    rows = sorted(m.lines.select("pos", "event_id", "template_online").collect())
    assert [(int(r.event_id[1:]), r.template_online) for r in rows] == want
    assert sorted(r.template for r in m.templates.collect()) == sorted(texts)


def test_mining_goes_on_from_a_prior_run(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", W]
    lines = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(120)]
    df = lines_df(spark, lines)
    a = tm.mine(df.where("pos < 60"), chunk_lines=10, max_children=3)
    b = tm.mine(df.where("pos >= 60"), chunk_lines=10, max_children=3, prior=(a.steps, a.branches))
    want, texts = one_by_one(lines, max_children=3)
    got = a.lines.select("pos", "template_online").unionByName(b.lines.select("pos", "template_online"))
    assert [r.template_online for r in sorted(got.collect())] == [w[1] for w in want]
    assert sorted(r.template for r in b.templates.collect()) == sorted(texts)


def test_a_line_of_few_words_is_a_template_each_time(spark):
    lines = ["7 8 9", "Disk 4 5", "7 8 9", "7 8 9", "Disk 4 5"]
    want, _ = one_by_one(["<*> <*> <*>", "Disk <*> <*>", "<*> <*> <*>", "<*> <*> <*>", "Disk <*> <*>"])
    rows, templates, m = mined(spark, lines, chunk_lines=2)
    assert [int(r.event_id[1:]) for r in rows] == [w[0] for w in want] == [0, 1, 2, 3, 4]
    assert templates["E00003"] == "<*> <*> <*>"
    more = spark.createDataFrame([(9, "7 8 9")], "pos long, raw string")
    b = tm.mine(more, prior=(m.steps, m.branches))
    assert [r.event_id for r in b.lines.collect()] == ["E00005"] and b.templates.count() == 6


def test_numbers_and_quantities_share_an_event(spark):
    rows, templates, _ = mined(spark, [
        "ERROR [db] Database connection timeout after 30s", "ERROR [api] Database connection timeout after 60s"])
    assert len({r.event_id for r in rows}) == 1
    assert rows[0].event_id == "E00000"


def test_last_token_is_generalised(spark):
    rows, _, _ = mined(spark, [
        "INFO [ci] Build started for branch main", "INFO [ci] Build started for branch develop"])
    assert rows[0].template_online.endswith("main")
    assert rows[1].template_online.endswith(W) and "started" in rows[1].template_online
    assert rows[0].template == rows[1].template


def test_many_services_and_ports_make_one_template(spark):
    _, templates, _ = mined(spark, [f"INFO [svc-{i}] Service started on port {1000 + i}" for i in range(20)])
    assert len(templates) == 1


def test_summary_top_k_counts_and_examples(spark):
    lines = ["INFO [a] Build started", "ERROR [b] Disk full on node n1", "WARN [c] Slow query took 30ms on db",
             "DEBUG [d] Cache hit", "INFO [e] Deploy to production finished cleanly now", "FATAL [f] Out of memory",
             "INFO [g] Tests passed with coverage 87 and nothing skipped today"] + ["INFO [a] Build started"] * 5
    m = tm.mine(lines_df(spark, lines))
    top = tm.summarise(m.lines, m.templates, lines_df(spark, lines), top_k=5).collect()
    assert len(top) == 5 and top[0]["count"] == 6 and len(top[0].examples) == 3
    assert [r["count"] for r in top] == sorted((r["count"] for r in top), reverse=True)
    assert m.templates.count() == 7


def test_parse_batch_records(spark):
    lines = ["2024-01-01 00:00:00 INFO [auth-service] Build started", "no stamp here at all",
             "2024-01-01 00:00:05 WARN [db] low memory 30", ""]
    recs = sorted(tm.parse_batch(lines_df(spark, lines)).collect(), key=lambda r: r.pos)
    assert [r.log_level for r in recs] == ["INFO", "UNKNOWN", "WARNING", "UNKNOWN"]
    assert recs[0].service == "auth-service" and recs[1].service is None
    assert [r.timestamp_delta_sec for r in recs] == [None, None, 5.0, None]
    assert recs[3].template == W and recs[3].parameters == []


def test_assign_leaves_templates_alone(spark):
    m = tm.mine(lines_df(spark, ["INFO [aa] Build started on node alpha", "INFO [aa] Build started on node beta"]))
    new = spark.createDataFrame([(1, "INFO [bb] Build started on node gamma"), (2, "totally different words")], "id int, raw string")
    got = tm.assign(new.withColumn("masked", tm.masked_line(F.col("raw"))), m.templates, m.branches)
    assert {r.id: r.event_id for r in got.collect()} == {1: "E00000", 2: "__OTHER__"}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_assign_finds_the_closest_among_many_templates(spark, monkeypatch, block):
    """Templates are compared as rows, in blocks, and those of few words not at all."""
    monkeypatch.setattr(tm, "BLOCK", block)
    rnd = random.Random(block)
    words = ["alpha", "beta", "gamma", "delta", "eps", W]

    def some(n):
        return [["one", "two"][: rnd.randrange(3)] + [rnd.choice(words) for _ in range(rnd.choice([3, 5, 8]))] for _ in range(n)]

    stored = [" ".join(t) for t in some(150)] + [W] * 50 + [f"{W} {W} {W}"] * 30
    base = spark.createDataFrame([(i, x) for i, x in enumerate(stored)], "pos long, masked string")
    routed, branches = tm.with_leaf(base, tm.DEPTH, 100)
    templates = routed.select(
        "leaf", F.format_string("E%d", "pos").alias("event_id"), F.col("masked").alias("template"), F.col("pos").alias("first_pos"))
    asked = [" ".join(t) for t in some(150)] + [W, W, f"{W} {W} {W}", "never seen here"]
    seen = {(len(t), *t[:2]) for t in (x.split(" ") for x in stored)}

    def closest(line):
        toks, best = line.split(" "), None
        for i, x in enumerate(stored):
            t = x.split(" ")
            if len(t) == len(toks) and t[:2] == toks[:2]:
                score = (sum(a == b != W for a, b in zip(t, toks)) / len(toks), t.count(W), -i)
                best = max(best or score, score)
        return f"E{-best[2]}" if best and best[0] >= tm.SIMILARITY else "__OTHER__"

    # Lines whose first words no template has go to the wildcard branch; they are not compared here.
    known = [x for x in asked if (len(x.split(" ")), *x.split(" ")[:2]) in seen or x == "never seen here"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(known)], "id long, masked string")
    got = tm.assign(df, templates, branches)
    assert {r.id: r.event_id for r in got.collect()} == {i: closest(x) for i, x in enumerate(known)}
    assert got.count() == len(known) and "__OTHER__" != closest(stored[0])
    assert "collect_list(struct(event_id" not in got._jdf.queryExecution().optimizedPlan().toString()
