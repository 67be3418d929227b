"""URL filter, hard negatives and conversation repair."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildlark.llm import hard_negatives, queries, repair, url_filter
from tests.oracle import compare, connect

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives"])
def test_equals_duckdb(spark, sf, name):
    assert compare(name, spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) is None


# --- URL filter -----------------------------------------------------------------------------------
def test_url_plan_has_no_python(spark, sf):
    plan = entry.queries()["op11_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


PAGES = "page_id long, url string, host string, bad int, rule int"
OUTCOMES = "page_id long, bad int"


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x", 7, 8) for i, u in enumerate(urls)], PAGES)
    got = url_filter.judge(pages, spark.createDataFrame(list(outcomes), OUTCOMES), queries.RULES).collect()
    return {r.page_id: r for r in got}


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "ftp://badexample.org/en/1", "x://com/fr/", "x://a.com/de/1#z",
        "x://a.com?y=://b.org/", "x://b.com#f", "no scheme", None, "", "x://", "x://org", "x://example.org:80/es/", "x://É.ORG/",
        "x://a.org/" + "p" * 200_000, "http://h/p?q", "a://b://c/d", "x://a.net/fr/\n/x?",
    ]
    got = judged(spark, urls)
    want = [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("badexample.org", "/en/1", "org/", "allow"), ("com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"),
        ("a.com", "", None, "allow"), ("b.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("org", "", None, "allow"), ("example.org:80", "/es/", None, "allow"), ("É.org", "/", "org/", "allow"),
        ("a.org", "/" + "p" * 200_000, "org/", "allow"), ("h", "/p", None, "allow"), ("b:", "//c/d", None, "allow"), ("a.net", "/fr/\n/x", None, "allow"),
    ]
    # Without outcomes the prior rate is one half, above the bound only with certainty.
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [w[:3] for w in want]
    assert [got[i].verdict for i in range(len(urls)) if want[i][2]] == [w[3] for w in want if w[2]]


def test_longest_rule_and_ties(spark):
    rules = [("allow", "a.b", "/"), ("block", "b", "/x/"), ("allow", "b", "/"), ("block", "c", "/"), ("allow", "c", "/")]
    rows = spark.createDataFrame([("a.b", "/x/1"), ("a.b", "/y"), ("b", "/x/"), ("c", "/")], "host string, path string")
    fit = url_filter.fitting_rule(F.col("host"), F.col("path"), rules)
    got = rows.select(fit.alias("f")).select("f.text", "f.action").collect()
    assert [tuple(r) for r in got] == [("a.b/", "allow"), ("a.b/", "allow"), ("b/x/", "block"), ("c/", "block")]


def plain_reputation(counts, tolerated=url_filter.TOLERATED):
    """{host: (mean, a, b)} by the stated priors, in plain Python."""
    def domain(h):
        return ".".join(h.split(".")[-2:])

    def top(h):
        return h.split(".")[-1]

    def level(of, means):
        units = {}
        for h, (n, k) in counts.items():
            u = units.setdefault(of(h), [0, 0, h])
            u[0], u[1] = u[0] + n, u[1] + k
        over = room = 0.0
        for n, k, h in units.values():
            m = means[h]
            over += (k - n * m) ** 2 - n * m * (1 - m)
            room += n * (n - 1) * m * (1 - m)
        r = min(1 / 3, max(1 / 1001, over / room)) if room else 1 / 1001
        s = 1 / r - 1
        out = {u: ((k + s * means[h]) / (n + s)) for u, (n, k, h) in units.items()}
        return {h: out[of(h)] for h in counts}, s

    base = (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)
    m1, _ = level(top, {h: base for h in counts})
    m2, _ = level(domain, m1)
    mean, s = level(lambda h: h, m2)
    return {h: (mean[h], counts[h][1] + s * m2[h], counts[h][0] - counts[h][1] + s * (1 - m2[h])) for h in counts}


def test_reputation_blocks_bad_hosts_only(spark):
    rng = random.Random(3)
    rates = {"bad.spam.com": 0.9, "m.spam.com": 0.8, "good.fine.com": 0.05, "a.fine.com": 0.1, "b.fine.org": 0.1, "c.mid.org": 0.15, "new.spam.com": None, "tiny.mid.org": 0.0}
    pages, outcomes, counts = [], [], {}
    for h, rate in rates.items():
        n = 2 if h.startswith("tiny") else 120
        counts[h] = [0, 0]
        for _ in range(n):
            i = len(pages)
            pages.append((i, h))
            if rate is not None:
                bad = int(rng.random() < rate)
                outcomes.append((i, bad))
                counts[h][0] += 1
                counts[h][1] += bad
    outcomes += [(5, 0), (None, 1), (9, None), (10_000, 1)]  # the worst outcome of page 5 stays
    pages += [pages[0]] * 50 + [(None, "c.mid.org")] * 20
    got = url_filter.reputation(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(outcomes, OUTCOMES)).collect()
    want = plain_reputation(counts)
    rng = np.random.default_rng(1)
    for r in got:
        mean, a, b = want[r.host]
        assert (r.n, r.k) == tuple(counts[r.host]) and r.mean == pytest.approx(mean)
        lower = np.quantile(rng.beta(a, b, 200_000), 0.05)
        if abs(lower - url_filter.TOLERATED) > 0.01:
            assert r.blocked == (lower > url_filter.TOLERATED), r
    assert {r.host for r in got if r.blocked} >= {"bad.spam.com", "m.spam.com"}
    assert not {r.host for r in got if r.blocked} & {"good.fine.com", "a.fine.com", "b.fine.org", "tiny.mid.org"}


def test_no_pages(spark):
    assert judged(spark, []) == {}


# --- hard negatives ---------------------------------------------------------------------------------
def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for scale in (3, 300, 1 << 20, 1 << 40):
        for dims in (1, 64, 3_000):
            a, b = (np.floor(rng.uniform(-scale, scale, (5, dims))) for _ in range(2))
            got = hard_negatives.scores(a, b)
            whole = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
            assert got.tolist() == whole
    big = np.array([[10 ** 30, -3]], object)
    assert hard_negatives.scores(big, big).tolist() == [[10 ** 60 + 9]]
    assert hard_negatives.scores(np.full((1, 1), 1e200), np.full((1, 1), 1e200)).tolist() == [[int(1e200) ** 2]]
    assert hard_negatives.scores(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def plain_negatives(rows):
    use = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, np.float32(v).astype(float).tolist())
        use[i] = min(use[i], key) if i in use else key
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in use.items()}
    out = []
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        most = (1 << 63) - 1
        got = sorted((-max(-most, min(most, sum(x * y for x, y in zip(q, w)))), i, lab) for i, (lab, w) in whole.items() if len(w) == len(q) and i != a)
        for s, p, _ in [g for g in got if g[2] == label][:5]:
            inside = [(-t, i) for t, i, lab in got if lab != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20), (90, 20)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "BLOCK", sizes[0])
    monkeypatch.setattr(hard_negatives, "PART", sizes[1])
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.5, 3.0]) for _ in range(6)], rng.randrange(3)) for i in range(-100, 450)]
    rows += [(600 + i, [0.5] * 6, i % 2) for i in range(40)]  # ties
    rows += [(700, [1.0] * 6, None), (800, None, 1), (900, [NAN] * 6, 1), (1000, [INF] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (1100, [None] * 6, 1)]
    rows += [(1200, [1.0, 2.0], 1), (1201, [2.0, 2.0], 1), (1202, [2.0, 1.5], 2), (1300, [0.0] * 6, 0), (1400, [-9.0] * 6, 2), (1500, [2e15] * 6, 1)]
    rows += [(0, rows[100][1], rows[100][2])] * 3 + [(100, [9.0] * 6, 5), (1600, [], 1), (1601, [], 1), (1602, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("dim", F.lit("x"))
    got = hard_negatives.mine(hard_negatives.usable(df), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_hard_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.usable(df), F.col("vec_id") % 100 == 0).count() == 0


# --- conversation repair ------------------------------------------------------------------------------
def shown(x):
    return " " if x is None else str(x)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


WHITE = " \t\n\x0b\f\r"


def plain_repair(rows):
    """Cheapest audits by memoised recursion from the end, over rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(WHITE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    step = repair.NEXT

    @functools.cache
    def best(k, q, inserted):
        """(cost, audit, lines) from row k in state q; at most two turns are inserted in one place."""
        options = [(0, "", ())] if k == len(rows) and q in (0, 3) else []
        if inserted < 2:
            for x, role in repair.ROLE.items():
                if (q, x) in step:
                    c, a, lines = best(k, step[q, x], inserted + 1)
                    options.append((c + 2, "I" + a, (f"{role}:", *lines)))
        if k < len(rows):
            _, _, role, text = rows[k]
            c, a, lines = best(k + 1, q, 0)
            options.append((c + 3, "D" + a, lines))
            if faults[k] not in ("blank", "duplicate"):
                extra = faults[k] == "truncated"
                if (q, role[:1]) in step:
                    c, a, lines = best(k + 1, step[q, role[:1]], 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                for x, new in repair.ROLE.items():
                    if (q, x) in step:
                        c, a, lines = best(k + 1, step[q, x], 0)
                        options.append((c + extra + 2, "R" + a, (f"{new}:{text}", *lines)))
        return min(options) if options else (10 ** 9, "", ())

    cost, audit, lines = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_all(rows):
    after = plain_damage(rows)
    return {c: plain_repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("x")).withColumn("copies", F.lit(9))
    got = repair.with_all(repair.repair(repair.damage(df.repartition(parts))), df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def odd_conversations():
    rng = random.Random(12)
    texts = ["ok.", "ok", "", " \t\n", None, "why?", "yes!", "é.\u00a0", "no. \n", "x" * 50_000, "a.\x1c"]
    roles = ["user", "assistant", "system", None, "", "tool", "admin", "User", "s"]
    rows = []
    for conv in range(150):
        n = rng.randrange(1, 9)
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts[:9]) if rng.random() < 0.5 else f"{turn} {rng.random()}."))
    rows += [(None, t, "user", "no id.") for t in (0, 1, None)]
    rows += [(500, t, r, x) for t, r, x in [(0, "user", texts[9]), (1, "assistant", texts[10])]]
    rows += [(501, 3, "user", "same.")] * 40 + [(502, t, "user", "same.") for t in range(30)]
    return rows


def test_repair_equals_plain(spark):
    rows = odd_conversations()
    assert repaired(spark, rows) == plain_all(rows)


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_long_conversations_in_fragments(spark, monkeypatch, limit):
    """The conversations of the test above and one longer one, cut into small fragments."""
    monkeypatch.setattr(repair, "FRAGMENT_ROWS", limit)
    rng = random.Random(limit)
    rows = [r for r in odd_conversations() if (r[0] or 0) < 40] + [
        (1000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", f"{t}.", f"{t}", "", "c"])) for t in range(160)
    ]
    assert repaired(spark, rows) == plain_all(rows)


def test_repair_on_test_data(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op13_repair_conversations"](spark, sf).collect()}
    assert got == plain_all(rows)


def test_repair_of_no_rows(spark):
    assert repaired(spark, []) == {}
