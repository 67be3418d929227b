"""Features, models, explanations, sequences and forecasts on small fixtures."""

import itertools
import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from buildlark.operators import explain, features, forecast, metrics, models, ordering, sequences, templates

SMALL = models.Settings(rf_trees=8, rf_depth=4, gbt_rounds=4, gbt_depth=3, lr_iterations=50)


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"2024-01-01 00:00:{i % 60:02d} INFO [svc-{i % 3}] Request processed in {i}ms", False))
        rows.append((100 + i, f"ERROR [svc-{i % 4}] Connection refused by host 10.0.0.{i}", True))
    return spark.createDataFrame(rows, "id long, log_text string, is_anomaly boolean").repartition(3)


@pytest.fixture(scope="module")
def clf(lines):
    return models.train(lines, settings=SMALL)


def test_tfidf_long_matches_plain_formula(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma 12"), (3, "alpha")], "id int, t string")
    vocab = features.vocabulary(docs, "t")
    df = {r.term: r.df for r in vocab.collect()}
    assert df == {"alpha": 2, "alpha beta": 1, "beta": 2, "beta beta": 1, "beta gamma": 1, "gamma": 1, "gamma num": 1, "num": 1}
    got = {(r.id, r.term): r.weight for r in features.tfidf_long(docs, "id", "t", vocab).collect()}
    idf = lambda t: math.log(4 / (1 + df[t])) + 1
    raw = {"alpha": idf("alpha"), "beta": (1 + math.log(2)) * idf("beta"), "alpha beta": idf("alpha beta"), "beta beta": idf("beta beta")}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    for t, v in raw.items():
        assert got[1, t] == pytest.approx(v / norm)


def test_tfidf_long_shuffles_nothing_and_takes_any_text(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta"), (2, ""), (3, None), (4, "unknown words"), (None, "beta " * 30_000)], "id int, t string"
    )
    vocab = features.vocabulary(docs.where("id = 1"), "t")
    out = features.tfidf_long(docs, "id", "t", vocab)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert {r.id for r in rows} == {1, None} and out.columns == ["id", "idx", "term", "weight"]
    assert [(r.term, r.weight) for r in rows if r.id is None] == [("beta", pytest.approx(1.0))]
    empty = features.vocabulary(docs.where("id = 2"), "t")
    none = features.tfidf_long(docs, "id", "t", empty)
    assert none.collect() == [] and none.schema == out.schema


def test_vector_equals_long_form(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma 12"), (3, "")], "id int, t string")
    space = features.feature_space(docs, "t", None)
    vec = {r.id: r.features for r in features.vectors(docs, "t", space).collect()}
    vocab = features.vocabulary(docs, "t")
    for r in features.tfidf_long(docs, "id", "t", vocab).collect():
        assert vec[r.id][int(r.idx)] == pytest.approx(r.weight)
    assert vec[3].numNonzeros() == 0 and vec[1].size == space.size


def test_structured_width_and_unseen_lines(spark, clf, lines):
    assert clf.space.size == len(clf.space.names) == len(set(clf.space.names))
    new = spark.createDataFrame([(1, "something never seen before")], "id int, log_text string")
    v = models.featurise(new, "log_text", clf).first().features
    assert v.size == clf.space.size
    assert v[clf.space.names.index("tmpl::__OTHER__")] == 1.0
    assert v[clf.space.names.index("lvl::UNKNOWN")] == 1.0


def test_train_needs_fifty_rows(lines):
    assert models.train(lines.limit(49)) is None


def test_cross_validation_and_best_model(clf):
    cv = {r.model_name: r for r in clf.cv.collect()}
    assert set(cv) == set(models.MODEL_ORDER)
    assert clf.folds.count() == models.FOLDS * len(models.MODEL_ORDER)
    assert all(0 <= r.cv_f1_mean <= 1 for r in cv.values())
    assert clf.best == max(models.MODEL_ORDER, key=lambda n: cv[n].cv_f1_mean)


def test_folds_and_whole_fit_wait_for_nothing(lines, monkeypatch):
    """All fits of a model are under way together; each waits here until all six have begun."""
    begun, fit = threading.Barrier(models.FOLDS + 1), models._fit

    def together(*args):
        begun.wait(60)
        return fit(*args)

    monkeypatch.setattr(models, "_fit", together)
    got = models.train(lines, settings=models.Settings(models=(models.LR,), lr_iterations=5))
    assert set(got.models) == {models.LR} == {got.best}
    assert sorted((r.model_name, r.fold) for r in got.folds.collect()) == [(models.LR, k) for k in range(models.FOLDS)]


def test_evaluate_and_score(clf, lines):
    for r in models.evaluate(clf, lines).collect():
        assert r.tp + r.tn + r.fp + r.fn == 120 and 0 <= r.roc_auc <= 1
    s = models.score(clf, lines).collect()
    assert all(-1 <= r.anomaly_score <= 1 and 0.5 <= r.confidence <= 1 for r in s)
    assert sum(r.is_anomaly == r.log_text.startswith("ERROR") for r in s) > 110


def test_importance_sums_to_one(clf):
    imp = models.feature_importance(clf, 5000).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)


def test_contributions_add_up_to_the_forest(clf, lines, spark):
    ready = models.featurise(lines, "log_text", clf).select("id", F.lit(0).alias("label"), "features")
    trees = explain._trees(explain.node_table(spark, clf.models[models.RF]))
    got = {r.id: r.score for r in explain.contributions(ready, "id", trees).collect()}
    p = {r.id: r.p1 for r in models.predictions(clf.models[models.RF], ready, "id").collect()}
    assert len(got) == len(p)
    for k, v in p.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def known_value(tree, cells, known, at=0):
    """What a tree says of a row of which only some features are known."""
    if tree["left"][at] < 0:
        return tree["share"][at]
    f, below = int(tree["feature"][at]), [int(tree["left"][at]), int(tree["right"][at])]
    if f in known:
        return known_value(tree, cells, known, below[0] if cells.get(f, 0.0) <= tree["threshold"][at] else below[1])
    return sum(tree["cover"][b] / tree["cover"][at] * known_value(tree, cells, known, b) for b in below)


def shapley_by_subsets(tree, cells):
    used = sorted({int(f) for f, left in zip(tree["feature"], tree["left"]) if left >= 0})
    m, out = len(used), {}
    for f in used:
        others = [g for g in used if g != f]
        out[f] = sum(
            math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
            * (known_value(tree, cells, {*some, f}) - known_value(tree, cells, set(some)))
            for k in range(m) for some in itertools.combinations(others, k)
        )
    return out


def random_tree(rng, depth, features):
    """Features may come again on a path; a tree may be a single leaf."""
    nodes = {c: [] for c in ("left", "right", "feature", "threshold", "share", "cover")}

    def grow(level, cover):
        at = len(nodes["left"])
        leaf = level == 0 or rng.random() < 0.15
        row = {"left": -1, "right": -1, "feature": -1, "threshold": 0.0, "share": rng.random(), "cover": cover}
        for c in nodes:
            nodes[c].append(row[c])
        if not leaf:
            part = rng.choice([0.2, 0.5, 0.9])
            nodes["feature"][at], nodes["threshold"][at] = rng.randrange(features), rng.choice([0.0, 0.3, 0.6])
            nodes["left"][at] = grow(level - 1, cover * part)
            nodes["right"][at] = grow(level - 1, cover * (1 - part))
        return at

    grow(depth, 64.0)
    tree = {c: np.array(v) for c, v in nodes.items()}
    inner = tree["left"] >= 0
    for at in np.nonzero(inner)[0][::-1]:  # shares of inner nodes are those of their rows
        below = [tree["left"][at], tree["right"][at]]
        tree["share"][at] = sum(tree["share"][b] * tree["cover"][b] for b in below) / tree["cover"][at]
    return tree | {"leaves": explain.leaves(tree)}


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_equal_subsets(seed):
    rng = random.Random(seed)
    trees = [random_tree(rng, d, 6) for d in (0, 1, 3, 5)]
    rows = [{f: rng.choice([0.1, 0.5, 0.9]) for f in range(6) if rng.random() < 0.6} for _ in range(9)] + [{}]
    idx, val = pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))
    _, got, _ = explain._shapley(trees, idx, val)
    for i, r in enumerate(rows):
        want = {}
        for t in trees:
            for f, v in shapley_by_subsets(t, r).items():
                want[f] = want.get(f, 0.0) + v / len(trees)
        assert all(got[i, f] == pytest.approx(want.get(f, 0.0), abs=1e-12) for f in range(got.shape[1]))
        total = sum(known_value(t, r, set(range(6))) for t in trees) / len(trees)
        assert got[i].sum() + np.mean([t["share"][0] for t in trees]) == pytest.approx(total, abs=1e-12)


def test_shapley_with_sides_that_no_row_took():
    tree = {"left": np.array([1, 3, -1, -1, -1]), "right": np.array([2, 4, -1, -1, -1]), "feature": np.array([0, 1, -1, -1, -1]),
            "threshold": np.zeros(5), "share": np.array([0.25, 0.25, 0.9, 0.25, 0.6]), "cover": np.array([8.0, 8.0, 0.0, 8.0, 0.0])}
    tree["leaves"] = explain.leaves(tree)
    rows = [{}, {0: 1.0}, {1: 1.0}, {0: 1.0, 1: 1.0}]
    idx, val = pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))
    _, got, _ = explain._shapley([tree], idx, val)
    assert got.tolist() == [pytest.approx([shapley_by_subsets(tree, r)[f] for f in (0, 1)]) for r in rows]


def test_explanation_shape(clf, lines):
    out = explain.explain(clf, lines, "id").collect()
    assert len(out) == 120
    for r in out:
        e = r.shap_explanation
        assert e.model == models.RF and len(e.features) == 3
        assert all(f.direction == ("anomaly" if f.shap_value >= 0 else "normal") for f in e.features)
        sizes = [abs(f.shap_value) for f in e.features]
        assert sizes == sorted(sizes, reverse=True) and all(f.tfidf > 0 for f in e.features)


def test_save_and_load(clf, lines, tmp_path):
    models.save(clf, str(tmp_path / "m"))
    back = models.load(str(tmp_path / "m"))
    a = {r.id: r.anomaly_score for r in models.score(clf, lines).collect()}
    b = {r.id: r.anomaly_score for r in models.score(back, lines).collect()}
    assert a == pytest.approx(b) and back.best == clf.best


def test_sequence_vocabulary_and_encoding(spark):
    lines = spark.createDataFrame(
        [(0, 0, "Hello world 80"), (0, 1, "hello again"), (1, 0, "world rare " + "x " * 40)], "build long, pos long, line string")
    toks = sequences.tokenised(lines)
    vocab = {r.token: r.id for r in sequences.vocabulary(toks).collect()}
    assert vocab == {"hello": 2, "world": 3, "<num>": 4, "again": 5, "rare": 6, "x": 7}
    common = sequences.vocabulary(toks, min_freq=2)
    assert {r.token: r.id for r in common.collect()} == {"hello": 2, "world": 3, "x": 4}
    ids = {r.build: r.ids for r in sequences.encode(toks, common).collect()}
    assert len(ids[0]) == 20 and all(len(x) == 30 for x in ids[0])
    assert ids[0][0][:4] == [2, 3, 1, 0] and ids[0][1][:3] == [2, 1, 0] and ids[0][2] == [0] * 30
    assert ids[1][0] == [3, 1] + [4] * 28


@pytest.mark.parametrize("kind", ["string", "struct<job:string,number:int>"])
def test_builds_told_by_texts_or_structs(spark, kind):
    def key(n):
        return f"job-{n}" if kind == "string" else ("job", n)

    rows = [(key(2), 0, "late words"), (key(1), 0, "first line"), (key(1), 1, "line two")]
    lines = spark.createDataFrame(rows, f"build {kind}, pos long, line string")
    toks = sequences.tokenised(lines)
    vocab = sequences.vocabulary(toks)
    assert {r.token: r.id for r in vocab.collect()} == {"first": 2, "line": 3, "two": 4, "late": 5, "words": 6}
    assert sequences.encode(toks, vocab).count() == 2
    assert sequences.escalation(lines).count() == 2


def test_long_builds_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "_BLOCK", 3)
    rows = [(b, p, "INFO fine") for b, n in ((0, 11), (1, 1), (2, 3)) for p in range(n)]
    out = sequences.phased(spark.createDataFrame(rows, "build long, pos long, line string")).collect()
    assert sorted((r.build, r.pos, r.n_lines, r.phase) for r in out) == [
        (b, p, n, min(4, p * 5 // n)) for b, n in ((0, 11), (1, 1), (2, 3)) for p in range(n)]


def test_escalation_sees_late_errors(spark):
    rows = [(b, p, "ERROR failed" if b == 1 and p >= 15 else "INFO fine") for b in (0, 1) for p in range(20)]
    df = spark.createDataFrame(rows, "build long, pos long, line string")
    got = {r.build: r for r in sequences.escalation(df).collect()}
    assert got[0].errors == 0 and got[0].last_error_at == 0
    assert got[1].late_errors == 5 and got[1].last_error_at == 1.0 and got[1].sev_mean_4 == 4.0 and got[1].sev_mean_0 == 2.0


def test_forecast(spark):
    fail = [2, 4, 1, 6, 3, 3, 7, 2, 5, 4, 8, 1, 6, 5, 9, 3, 7]
    rows = [("a", i, v) for i, v in enumerate(fail)] + [("short", i, 1) for i in range(9)]
    rows += [("flat", i, 3) for i in range(12)] + [("neg", i, v) for i, v in enumerate([-1] + [2] * 11)]
    got = {r.s: r for r in forecast.forecast(spark.createDataFrame(rows, "s string, hour int, failures int"), "s").collect()}
    a = got["a"]
    assert 0 <= a.lower_bound <= a.predicted_failures <= a.upper_bound and a.error is None
    assert got["short"].error == "Model not trained" and got["short"].predicted_failures == 0
    assert got["flat"].predicted_failures == got["flat"].upper_bound == 3
    assert got["neg"].n_points == 11


def test_forecast_recovers_a_known_process():
    rng = np.random.default_rng(1)
    e, d = rng.normal(size=3000), np.zeros(3000)
    for t in range(1, 3000):
        d[t] = 0.6 * d[t - 1] + e[t] + 0.3 * e[t - 1]
    x = np.cumsum(d)
    mean, sigma = forecast.fit_next(x[:-1])
    assert sigma == pytest.approx(1.0, abs=0.05) and abs(mean - x[-1]) < 4


def test_confusion_and_area_of_rows_told_apart(spark):
    y = [i % 3 == 0 for i in range(12)]
    s = [0.6 + i / 40 if bad else i / 40 for i, bad in enumerate(y)]
    y = [int(bad) for bad in y]
    df = spark.createDataFrame([(a, b, int(b > .5)) for a, b in zip(y, s)], "label int, score double, prediction int")
    c = metrics.confusion(df, "label", "prediction").first()
    assert (c.tp, c.tn, c.fp, c.fn, c.specificity) == (4, 8, 0, 0, 1.0)
    from buildlark.operators.curves import auc
    assert auc(df).first().auc == 1.0


@pytest.mark.parametrize("cuts", [2, 7, 64])
def test_ordering_helpers_do_not_depend_on_the_cuts(spark, cuts):
    rng = np.random.default_rng(cuts)
    x = [float(v) for v in rng.permutation(200)]
    df = spark.createDataFrame([(v, int(v) % 7) for v in x], "x double, n int").repartition(5)
    run = {r.x: r.n for r in ordering.running_sums(df, "x", ["n"], cuts=cuts).collect()}
    total = 0
    for v in sorted(x, reverse=True):
        total += int(v) % 7
        assert run[v] == total
    prev = {r.x: r.prev_n for r in ordering.neighbour_before(df, "x", ["n"], cuts=cuts).collect()}
    assert prev[199.0] is None and all(prev[v] == (int(v) + 1) % 7 for v in x if v < 199)
    no = {r.x: r.no for r in ordering.number_globally(df, "x", "no", cuts).collect()}
    assert no == {v: int(v) + 1 for v in x}


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_last_value_before(spark, chunk):
    rows = [(g, p, (p if (p * 7 + g) % 3 else None)) for g in (0, 1) for p in range(40)]
    df = spark.createDataFrame(rows, "g int, p long, v long").repartition(4)
    got = {(r.g, r.p): r.o for r in ordering.last_value_before(df, ["g"], "p", "v", "o", chunk).collect()}
    for g in (0, 1):
        last = None
        for _, p, v in [r for r in rows if r[0] == g]:
            assert got[g, p] == last
            last = v if v is not None else last


def test_rolling_forecast_equals_a_fit_by_hand(spark):
    """Each hour's forecast is that of a least-squares line fitted to what was known then."""
    rng = random.Random(5)
    rows = [("a", h, rng.randrange(9)) for h in range(60)] + [("b", h, 4) for h in range(20)] + [("c", 0, 3)] + [("a", 60, -1)]
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, "job string, h int, failures int").withColumn("hour", start + F.make_interval(hours=F.col("h")))
    got = {(r.job, r.valid_from.day * 24 + r.valid_from.hour - 25): r for r in forecast.rolling(df, "job").collect()}
    assert len(got) == 81
    for (job, h), r in got.items():
        y = np.array([v for j, k, v in rows if j == job and k <= h], float)
        assert r.n_points == len(y)
        if len(y) < 10:
            want = (0, 0, 0)
        else:
            d = np.diff(y)
            slope, base = np.polyfit(d[:-1], d[1:], 1) if d[:-1].std() else (0.0, d[1:].mean())
            mean = y[-1] + base + slope * d[-1]
            sigma = np.sqrt(((d[1:] - base - slope * d[:-1]) ** 2).mean())
            want = tuple(int(max(0, np.round(v, 6))) for v in (mean, mean - 1.96 * sigma, mean + 1.96 * sigma))
        assert (r.predicted_failures, r.lower_bound, r.upper_bound) == want


def test_requests_get_the_forecast_of_their_time(spark):
    from buildlark.operators import predict

    f = [("p", "2024-01-01 01:00:00", 1), ("p", "2024-01-01 02:00:00", 2), ("p", "2024-03-01 00:00:00", 3), ("q", "2024-01-01 00:00:00", 9), (None, "2024-01-01 00:00:00", 8)]
    ahead = spark.createDataFrame(f, "pipeline_id string, at string, predicted_failures int").select(
        "pipeline_id", F.col("at").cast("timestamp").alias("valid_from"), "predicted_failures", (F.col("predicted_failures") - 1).alias("lower_bound"), F.lit(10).alias("upper_bound"))
    r = [(1, "p", "2024-01-01 00:59:59", None), (2, "p", "2024-01-01 01:00:00", 1), (3, "p", "2024-01-01 01:59:59.999999", 1), (4, "p", "2024-02-09 00:00:00", 2),
         (5, "p", "2025-01-01 00:00:00", 3), (6, "q", "2024-01-05 00:00:00", 9), (7, "r", "2024-01-05 00:00:00", None), (8, None, "2024-01-05 00:00:00", None), (9, "p", None, None)]
    asked = spark.createDataFrame(r, "id long, pipeline_id string, at string, want int").withColumn("created_at", F.col("at").cast("timestamp"))
    got = predict.as_of(asked, ahead).collect()
    assert len(got) == 9 and all(x.predicted_failures == x.want for x in got)
    assert all((x.failure_lower_bound, x.failure_upper_bound) == ((None, None) if x.want is None else (x.want - 1, 10)) for x in got)
