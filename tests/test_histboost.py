"""Boosting against a plain one-machine version that walks rows and thresholds."""

import math
import random

import numpy as np
import pytest

from faretrace.models import boosting, histboost as hb
from registry.core import model_rows
from registry.model_queries import fit_rows


def plain_boost(rows, y, weights, start, squared, settings):
    """Trees as nested dicts, and the margins after them. ``rows`` hold numbers or None; every distinct value but the least
    is a cut."""
    n_features = len(rows[0])
    cuts = [sorted({r[f] for r in rows if r[f] is not None})[1:] for f in range(n_features)]
    margins, trees = [start] * len(rows), []

    def gain(g, h):
        return g * g / (h + settings.l2)

    def node(members, grads, depth):
        g, h = (sum(grads[i][k] for i in members) for k in (0, 1))
        best = None
        if depth < settings.depth:
            for f in range(n_features):
                there = [i for i in members if rows[i][f] is not None]
                gone = [i for i in members if rows[i][f] is None]
                for cut in [*cuts[f], math.inf]:
                    for missing_left in (False, True):
                        left = [i for i in there if rows[i][f] < cut] + (gone if missing_left else [])
                        lg, lh = (sum(grads[i][k] for i in left) for k in (0, 1))
                        if lh < settings.least_weight or h - lh < settings.least_weight:
                            continue
                        won = (gain(lg, lh) + gain(g - lg, h - lh) - gain(g, h)) / 2
                        if won > (best[0] + 1e-9 if best else hb.LEAST_GAIN):
                            best = won, f, cut, missing_left, set(left)
        if best is None:
            return {"value": -settings.rate * g / (h + settings.l2)}
        won, f, cut, missing_left, left = best
        return {"gain": won, "feature": f, "cut": cut, "missing_left": missing_left,
                "kids": (node([i for i in members if i in left], grads, depth + 1),
                         node([i for i in members if i not in left], grads, depth + 1))}

    def value(tree, row):
        while "kids" in tree:
            x = row[tree["feature"]]
            tree = tree["kids"][0 if (tree["missing_left"] if x is None else x < tree["cut"]) else 1]
        return tree["value"]

    for _ in range(settings.trees):
        grads = []
        for m, t, w in zip(margins, y, weights):
            p = 1 / (1 + math.exp(-m))
            grads.append((m - t, 1.0) if squared else (w * (p - t), w * p * (1 - p)))
        trees.append(node(list(range(len(rows))), grads, 0))
        margins = [m + value(trees[-1], r) for m, r in zip(margins, rows)]
    return trees, margins


def same_tree(plain, tree, node=1):
    assert ("kids" in plain) == tree.split[node]
    if "kids" not in plain:
        assert plain["value"] == pytest.approx(tree.value[node], rel=1e-7, abs=1e-10)
        return
    assert plain["feature"] == tree.feature[node] and plain["cut"] == tree.cut[node]
    assert plain["gain"] == pytest.approx(tree.gain[node], rel=1e-6)
    same_tree(plain["kids"][0], tree, 2 * node)
    same_tree(plain["kids"][1], tree, 2 * node + 1)


@pytest.fixture(scope="module")
def table(spark):
    """Missing values carry the label in part, differently on both sides of another predictor."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b, c = rng.randrange(12), rng.choice([0.25, 0.5, 4.0, 9.0, None]), rng.choice([None, None, 1.0, 2.0])
        label = float((c is None) == (a > 6) if rng.random() < 0.85 else rng.random() < 0.5)
        rows.append((i, float(a), b, c, None if i % 60 == 7 else label, 100 + 7.5 * a + (20 if b is None else b) + rng.random()))
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fare double").cache()
    return rows, frame


SMALL = hb.Settings(trees=4, depth=3, rate=0.3)


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("target,squared,weight", [("label", False, 1.0), ("label", False, None), ("fare", True, 1.0)])
def test_equals_plain_version(table, monkeypatch, target, squared, weight, spread):
    rows, frame = table
    if spread:
        monkeypatch.setattr(hb, "ROWS_A_PARTITION", 90)
        monkeypatch.setattr(hb, "CUT_EVERY", 2)
    at = {"label": 4, "fare": 5}[target]
    used = [r for r in rows if r[at] is not None]
    (forest,) = hb.fit_many(frame, [hb.Task("x", "true", ("a", "b", "c"), target, squared, weight)], SMALL)
    y = [r[at] for r in used]
    if weight is None:
        assert forest.weight == (len(y) - sum(y)) / sum(y)
    weights = [forest.weight if t == 1 else 1.0 for t in y]
    trees, margins = plain_boost([r[1:4] for r in used], y, weights, forest.start, squared, SMALL)
    for plain, tree in zip(trees, forest.trees, strict=True):
        same_tree(plain, tree)
    got = {r["id"]: r["score"] for r in hb.predictions(frame, [forest], ["true"], ["id"], SMALL.depth).collect()}
    for r, m in zip(used, margins):
        assert got[r[0]] == pytest.approx(m if squared else 1 / (1 + math.exp(-m)), rel=1e-7)
    assert sum(share for _, share in forest.importance()) == pytest.approx(1)


def same_forest(a, b):
    assert a.start == b.start and a.weight == b.weight
    for x, y in zip(a.trees, b.trees, strict=True):
        assert np.array_equal(x.split, y.split) and np.array_equal(x.feature, y.feature) and np.array_equal(x.cut, y.cut)
        assert np.allclose(x.value, y.value, rtol=1e-9, atol=1e-12) and np.array_equal(x.missing_left, y.missing_left)


TASKS = [hb.Task("early", "id < 150", ("a", "b", "c")), hb.Task("late", "id >= 60", ("c", "a"), positive_weight=None),
         hb.Task("all", "true", ("b", "c"))]


def test_fits_of_a_batch_equal_single_fits(table, monkeypatch):
    """Also over several partitions, whose histograms meet in a shuffle, and over several blocks and checkpoints."""
    _, frame = table
    monkeypatch.setattr(hb, "CUT_EVERY", 2)
    alone = [hb.fit_many(frame, [t], SMALL)[0] for t in TASKS]
    monkeypatch.setattr(hb, "ROWS_A_PARTITION", 90)
    monkeypatch.setattr(hb, "BLOCK_ROWS", 40)
    for one, other in zip(alone, hb.fit_many(frame, TASKS, SMALL), strict=True):
        same_forest(one, other)


def jobs_of(spark, run):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boost", "")
    before = len(tracker.getJobIdsForGroup("boost"))
    run()
    after = len(tracker.getJobIdsForGroup("boost"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return after - before


@pytest.mark.parametrize("a_partition", [90, 100_000])
def test_jobs_do_not_grow_with_fits(spark, table, monkeypatch, a_partition):
    _, frame = table
    monkeypatch.setattr(hb, "ROWS_A_PARTITION", a_partition)
    one = jobs_of(spark, lambda: hb.fit_many(frame, TASKS[:1], SMALL))
    many = jobs_of(spark, lambda: hb.fit_many(frame, [hb.Task(f"t{i}", f"id % 9 <> {i}", ("a", "b", "c")) for i in range(9)], SMALL))
    assert many <= one + 2 and one <= 2 * SMALL.trees * SMALL.depth + 12


def test_missing_values_are_never_filled(table):
    """A predictor that says nothing but whether it is there separates the classes."""
    _, frame = table
    (forest,) = hb.fit_many(frame.withColumn("label", frame["c"].isNull()), [hb.Task("x", "true", ("c",))], SMALL)
    got = {(r["c"] is None): r["score"] for r in hb.predictions(
        frame.withColumn("label", frame["c"].isNull()), [forest], ["true"], ["c"], SMALL.depth).collect()}
    assert got[True] > 0.6 > 0.4 > got[False]


def test_all_missing_and_constant_predictors(spark):
    frame = spark.createDataFrame([(None, 1.0, float(i % 2)) for i in range(20)], "n double, k double, label double")
    (forest,) = hb.fit_many(frame, [hb.Task("x", "true", ("n", "k"))], SMALL)
    assert not any(t.split.any() for t in forest.trees) and forest.importance() == [("n", 0.0), ("k", 0.0)]
    with pytest.raises(ValueError, match="no training rows"):
        hb.fit_many(frame, [hb.Task("x", "false", ("n",))], SMALL)


def test_summaries_keep_ranks():
    rng = np.random.default_rng(1)
    values, weights = rng.normal(size=60_000).round(4), rng.uniform(0.1, 5, 60_000)
    merged = [hb._thinned(v, w, 512) for v, w in zip(np.array_split(values, 13), np.array_split(weights, 13))]
    v, w = (np.concatenate([m[k] for m in merged]) for k in (0, 1))
    assert w.sum() == pytest.approx(weights.sum())
    cuts = hb.cuts_of(v, w, 64)
    ranks = np.array([weights[values < c].sum() for c in cuts]) / weights.sum()
    assert len(cuts) == 63 and np.abs(ranks - np.arange(1, 64) / 64).max() < 2 / 512 + 1e-3
    assert hb.cuts_of(np.array([3.0, 1.0, 3.0, 2.0]), np.ones(4), 64).tolist() == [2.0, 3.0]


def spread_out(monkeypatch, rows=90, a_task=40):
    monkeypatch.setattr(hb, "ROWS_A_PARTITION", rows)
    monkeypatch.setattr(hb, "ROWS_SIDE_BY_SIDE", a_task)
    monkeypatch.setattr(hb, "BLOCK_ROWS", 20)


def test_fits_over_several_tasks_equal_single_fits(table, monkeypatch):
    """Their sums meet in files, some tasks hold rows of several fits and none holds rows of all."""
    _, frame = table
    alone = [hb.fit_many(frame, [t], SMALL)[0] for t in TASKS]
    spread_out(monkeypatch)
    for one, other in zip(alone, hb.fit_many(frame, TASKS, SMALL), strict=True):
        same_forest(one, other)


@pytest.mark.parametrize("held", [0, 40])
def test_fits_too_large_for_memory_equal_single_fits(table, monkeypatch, held):
    """A batch that the tasks cannot hold is halved; a fit that they cannot hold takes a job a level."""
    _, frame = table
    alone = [hb.fit_many(frame, [t], SMALL)[0] for t in TASKS]
    spread_out(monkeypatch)
    monkeypatch.setattr(hb, "HELD_ROWS", held)
    for one, other in zip(alone, hb.fit_many(frame, TASKS, SMALL), strict=True):
        same_forest(one, other)


def test_jobs_do_not_grow_with_trees_of_large_fits(spark, table, monkeypatch):
    _, frame = table
    spread_out(monkeypatch)
    few, many = (jobs_of(spark, lambda: hb.fit_many(frame, TASKS[:1], hb.Settings(trees=n, depth=3))) for n in (2, 9))  # noqa: B023
    assert many == few


def test_trees_are_the_same_bit_by_bit_however_rows_lie(table, monkeypatch):
    """Sums are exact, so neither their order nor sums taken as differences move a value."""
    _, frame = table
    tasks = [hb.Task("all", "true", ("a", "b", "c"), positive_weight=None)]
    (alone,) = hb.fit_many(frame, tasks, SMALL)
    for rows, held in ((90, hb.HELD_ROWS), (90, 0)):
        spread_out(monkeypatch, rows)
        monkeypatch.setattr(hb, "HELD_ROWS", held)
        (other,) = hb.fit_many(frame, tasks, SMALL)
        for x, y in zip(alone.trees, other.trees, strict=True):
            assert x.value.tolist() == y.value.tolist() and x.gain.tolist() == y.gain.tolist()


def test_levels_sum_the_smaller_children_in_one_pass_a_bundle(monkeypatch):
    rng = np.random.default_rng(3)
    n = 2000
    day = rng.integers(0, 40, n)
    bins = np.stack([day, day % 7, day % 7 > 4, rng.integers(0, 200, n), rng.integers(0, 250, n)]).astype(np.uint8)
    y = (rng.random(n) < 0.2 + 0.6 * (bins[3] > 90)).astype(float)
    bundles = hb._bundles(bins)
    assert sorted(sorted(m[0] for m in members) for _, members in bundles) == [[0, 1, 2], [3], [4]]
    missing = [np.array([40, 7, 2, 200, 250])]
    settings = hb.Settings(trees=2, depth=4)
    level = hb._Level([hb.Forest(hb.Task("x", "", tuple("abcde")), rows=n)], missing, settings)
    level.trees, level.open = [hb.Tree.empty(0)], [[]]
    read, met, count = [], [], np.bincount
    block = hb._Held(0, bins, y, np.zeros(n))

    def meet(sums):
        for node, of_node in zip(level.open[0], sums[0], strict=True):
            at = block.rows[node]
            for x, got in zip((block.g, block.h), of_node, strict=True):
                plain = np.concatenate([count(b[at], x[at], w + 1) for b, w in zip(bins, missing[0], strict=True)])
                assert got.tolist() == plain.tolist()
        met.append(len(level.open[0]))
        return {0: level.chosen(0, sums[0])}

    monkeypatch.setattr(np, "bincount", lambda x, *rest: read.append(len(x)) or count(x, *rest))
    list(level.grown([block], [0], meet))
    assert max(met) > 4
    # gradients and hessians of three bundles: all rows at the root, no more than half of them below
    assert len(read) == 6 * len(met) and sum(x > n // 2 for x in read) == 6 * settings.trees


def test_bins_of_a_fit_do_not_depend_on_where_its_rows_come_from(spark, monkeypatch):
    """Also with more values than a summary keeps, which tasks used to thin each by itself."""
    monkeypatch.setattr(hb, "SUMMARY", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    frame = spark.range(3000).selectExpr("id * 7919 % 3000 / 7D AS a", "CAST(id * 31 % 17 > 8 AS DOUBLE) AS label")
    task = hb.Task("x", "true", ("a",), positive_weight=None)
    try:
        one, other = (hb.fit_many(frame.repartition(n, column), [task], SMALL)[0] for n, column in ((2, "label"), (7, "a")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same_forest(one, other)
    assert any(tree.split.any() for tree in one.trees)


def test_windows_of_fits_are_computed_once(spark, sf):
    """Neither model rows nor designs are windowed again, or kept in all partitions of a shuffle, by those who read them."""
    rows = fit_rows(spark, sf)
    with boosting.kept(boosting.design_matrix(rows)) as design:
        for frame in (rows, design):
            plan = frame._jdf.queryExecution().toString()
            assert "Window" not in plan and "InMemory" not in plan and "Exchange" not in plan
        assert design.count() == model_rows(spark, sf).count() > 0


@pytest.mark.parametrize("squared", [False, True])
def test_held_rows_are_small_and_trees_the_same(monkeypatch, squared):
    """A row is its codes, target, margin, gradient, hessian and place; in units or not, sums are the same."""
    rng = np.random.default_rng(5)
    n = 60_000
    bins = np.stack([rng.integers(0, 200, n) for _ in range(8)]).astype(np.uint8)
    y = (rng.random(n) < 0.2 + 0.5 * (bins[2] > 120)).astype(float)
    missing = [np.full(8, 200)]

    def grown(rows):
        monkeypatch.setattr(hb, "COUNTED_ROWS", rows)
        task = hb.Task("x", "", tuple("abcdefgh"), squared=squared)
        level = hb._Level([hb.Forest(task, rows=1 << 22)], missing, hb.Settings(trees=3, depth=4))
        level.trees, level.open = [hb.Tree.empty(0)], [[]]
        block = hb._Held(0, bins, y, np.zeros(n))
        splits = [b.to_pydict() for b in level.grown([block], [0], lambda sums: {0: level.chosen(0, sums[0])})]
        arrays = [block.y, block.margin, block.g, block.h, *block.rows.values(), *(codes for codes, _ in block.bundles)]
        return splits, sum(x.nbytes for x in arrays), block

    (plain, _, _), (counted, size, block) = grown(1 << 40), grown(0)
    assert plain == counted and len(plain) > 6
    assert size <= n * (8 + 1 + 8 + (16 if squared else 8) + 4) and not hasattr(block, "bins")
