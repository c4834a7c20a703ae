"""Every query with SQL equals it on the smallest tables; plans of the joins stay free of pair comparison."""

import glob
import importlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import feature as ft
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC
from pyspark.ml.feature import Bucketizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sessiograph.operators import folds, models, packages, perceptron
from sessiograph.plans.catalog import catalog
from sessiograph.session import packed
from sessiograph.sources.bindings import Tables
from tests.conftest import DATA

ALL = catalog()
MODELS = sorted(set(ALL.queries) - set(ALL.sql))
SLOW = {"tfidf_features"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("key", sorted(set(ALL.sql) - SLOW))
def test_equals_sql(spark, db, key):
    df = ALL.queries[key](spark, DATA)
    rel = db.execute(ALL.sql[key])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    exact = [c for c, t in df.dtypes if t not in ("double", "float")]
    order = sorted(cols, key=lambda c: (c not in exact, c))

    def rows(raw, names):
        at = [names.index(c) for c in order]
        return sorted((tuple(r[i] for i in at) for r in raw), key=lambda r: tuple(str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r))
    got, want = rows([tuple(r) for r in df.collect()], df.columns), rows(rel.fetchall(), cols)
    assert len(got) == len(want) and (got or key in {"priority_key_join"})
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(close(a, b) for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:3]


JOINS = ["join_segments_features", "tolerance_join_pause", "interval_join_words", "priority_key_join", "candidate_subject_join", "chunk_frame_range_join",
         "nearest_point_join", "frame_sync_concat", "resolve_label", "grid_f1_threshold", "passage_bounds", "minmax_normalize", "fn_times"]


@pytest.mark.parametrize("key", JOINS)
def test_no_pair_comparison(spark, key):
    plan = ALL.queries[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = ALL.queries["top_segments"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_two_columns(spark):
    plan = ALL.queries["session_segment_count"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split(">")[0] or "conv_id" in plan


SMALL = packages.Settings(folds=3, max_terms=200, min_df=2, svc_iterations=20, rounds=5)


def test_held_out_scores_have_no_leaks(spark):
    sessions = folds.group_kfold(importlib.import_module("sessiograph.plans.models").training_sessions(Tables(spark, DATA)).drop("fold"), "group_id", 3)
    audio, seen = ["audio_loudness_mean", "audio_f0_mean"], []

    def fit(train):
        seen.append({r.group_id for r in train.select("group_id").collect()})
        return packages.tree_model(train, audio, SMALL)
    out, fitted = packages.held_out(sessions, 3, fit, "p_audio")
    rows = out.select("doc_id", "group_id", "p_audio").collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sessions.count() and all(0 <= r.p_audio <= 1 for r in rows)
    assert all(sum(r.group_id in groups for groups in seen) == 2 for r in rows)
    ranked = packages.mean_importances(spark, [packages.importances(m, audio) for m in fitted]).collect()
    assert [r.rank for r in ranked] == [1, 2] and abs(sum(r.importance for r in ranked) - 1) < 1e-9 and ranked[0].importance >= ranked[1].importance


def test_a_saved_package_scores_every_document(spark, tmp_path):
    plans = importlib.import_module("sessiograph.plans.models")
    t = Tables(spark, DATA)
    package = packages.SessionPackage.train(plans.training_sessions(t), "doc_id", plans.AUDIO, SMALL)
    package.save(str(tmp_path / "p"))
    assert packages.stored_at(spark, str(tmp_path / "p"))
    loaded = packages.SessionPackage.load(spark, str(tmp_path / "p"))
    silent = F.when(F.col("doc_id") % 7 != 3, F.lit(True))
    every = plans.sessions_to_score(t).withColumns({c: F.when(silent, F.col(c)) for c in plans.AUDIO})
    rows, again = ({r.doc_id: r for r in p.score(every).collect()} for p in (package, loaded))
    assert rows == again and len(rows) == t.table("documents").count()
    oof = {r.doc_id: r for r in package.oof.collect()}
    for r in rows.values():
        assert 0 <= r.p_text <= 1 and (r.p_final is None) == (r.p_audio is None)
        assert r.trained == (r.doc_id in oof) and (r.doc_id % 7 != 3 or r.p_final is None)
        if r.trained:
            assert r.p_text == oof[r.doc_id].p_text and r.p_final in (None, oof[r.doc_id].p_final)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_counts_of_folds_give_the_vectorizers_vocabulary(spark):
    rows = [(i, i % 3, [f"t{j}" for j in range(40) if (i * 7 + j * j) % (j + 2) < 2] + ["t1"]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, fold int, terms array<string>").repartition(8)
    counts = models.term_counts(df, "fold")
    for rest in (df, df.where("fold != 1")):
        known = counts if rest is df else counts.where("fold != 1")
        got = models.TextVectors.of_counts(known, rest.count(), 100, 3, 0.9)
        old = ft.CountVectorizer(inputCol="terms", outputCol="_counts", vocabSize=100, minDF=3.0, maxDF=0.9).fit(rest)
        assert set(got.stages[0].vocabulary) == set(old.vocabulary)
        idf = ft.IDF(inputCol="_counts", outputCol="_idf").fit(old.transform(rest)).idf.toArray()
        weights = dict(zip(got.stages[0].vocabulary, got.stages[2].getScalingVec().toArray(), strict=True))
        assert all(math.isclose(weights[t], w + 1, rel_tol=1e-12) for t, w in zip(old.vocabulary, idf, strict=True))


def test_small_training_tables_are_one_task(spark):
    df = spark.range(1000).repartition(8)
    assert packed(df, 1000).rdd.getNumPartitions() == 1 and packed(df, 150_001).rdd.getNumPartitions() == 4


def test_terms_are_counted_where_the_text_is(spark):
    plan = ALL.queries["tfidf_features"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("doc_id" in d.split("),")[0] and "term" in d.split("),")[0] for d in dealt)
    assert sum("doc_id" in d.split("),")[0] for d in dealt) <= 3


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "bb cc dd"), (4, None)], "doc_id int, text string")
    got = {(r.doc_id, r.term): r.weight for r in models.tfidf(df, "doc_id", "text", max_terms=None).collect()}
    idf = math.log(5 / 3) + 1
    raw = {1: {"aa": (1 + math.log(2)) * idf, "bb": idf}, 2: {"aa": idf, "cc": idf}, 3: {"bb": idf, "cc": idf}}
    want = {(d, t): w / math.sqrt(sum(x * x for x in ws.values())) for d, ws in raw.items() for t, w in ws.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_trees_learn_from_rows_of_equal_ranges(spark):
    plans = importlib.import_module("sessiograph.plans.models")
    assert set(plans.training_sessions(Tables(spark, DATA), dict).columns) == {"doc_id", "label", *plans.AUDIO, "group_id", "fold"}  # no text is read
    df = spark.range(4000).select((F.hash("id") % 997 / 7).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(5)) + 0.0).alias("y"))
    df = df.withColumn("label", ((F.col("x") > 20) & (F.col("y") != 2) | (F.col("y") == 4)).cast("int"))
    cuts = packages.cut_points(df, ["x", "y"])
    assert cuts[1] == [-math.inf, 0.5, 1.5, 2.5, 3.5, math.inf] and 30 <= len(cuts[0]) <= 33
    ranged = ft.Bucketizer(splitsArray=cuts, inputCols=["x", "y"], outputCols=["a", "b"]).transform(df)
    cells = packages.cells(ranged, ["a", "b", "label"])
    assert cells.count() <= 32 * 5 * 2 and cells.agg(F.sum("n")).first()[0] == 4000
    for balanced in (False, True):
        model = packages.tree_model(df, ["x", "y"], packages.Settings(rounds=20, rate=0.3, column_share=1.0), balanced)
        wrong = packages.with_score(model, df, "p").where((F.col("p") >= 0.5).cast("int") != F.col("label")).count()
        assert wrong < 4000 / 32  # only the range in which the border of x lies
        assert sum(packages.importances(model, ["x", "y"]).values()) > 0.99


def test_numbers_of_terms_are_joined_instead_of_terms(spark):
    plans, t = importlib.import_module("sessiograph.plans.models"), Tables(spark, DATA)
    got = {r.doc_id: (r.n_terms, r.distinct_terms) for r in plans.sessions_to_score(t, plans.term_numbers).drop(*plans.AUDIO).collect()}
    assert got == {r.doc_id: (len(r.terms), len(set(r.terms))) for r in plans.sessions_to_score(t).select("doc_id", "terms").collect()}
    assert not any(kind.startswith("array") for _, kind in plans.training_sessions(t, plans.term_numbers).dtypes)


def test_the_boosted_baseline_has_the_learners_settings():
    plans, gbt = importlib.import_module("sessiograph.plans.models"), models.learners()["gradient_boosting"]()
    b = plans.BOOSTED
    assert (b.rounds, b.depth, b.rate, b.min_rows, b.seed) == (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getMinInstancesPerNode(), gbt.getSeed())
    assert b.column_share == gbt.getSubsamplingRate() == b.row_share == 1.0 and packages.BINS == gbt.getMaxBins()


def test_trees_that_draw_rows_take_decimal_columns(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 50 / 7.0 as decimal(6, 3)) as x", "cast(id % 50 > 20 as int) as label")
    model = packages.tree_model(df, ["x"], packages.Settings(rounds=3, row_share=0.8, column_share=1.0), balanced=True)
    assert all((r.p >= 0.5) == (r.label == 1) for r in packages.with_score(model, df, "p").collect())


def test_the_perceptron_learns_from_weighted_rows_as_the_learner_does(spark):
    rows = [(x / 10, float((x * 7) % 11), int((x > 20) != ((x * 7) % 11 > 6)), x % 3 + 1) for x in range(40)]
    df = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "x double, y double, label int")
    learner = models.learners(width=2)["perceptron"]
    fitted = perceptron.fit_perceptron(df, ["x", "y"], learner())
    net, scaled = fitted.stages[-1], fitted.stages[1].transform(fitted.stages[0].transform(df))

    def loss(model):
        p = packages.with_score(model, df, "score").collect()
        return -sum(math.log(max(1e-12, r.score if r.label else 1 - r.score)) for r in p) / len(p)
    theirs = models.numeric_pipeline(["x", "y"], learner()).fit(df)
    assert loss(fitted) < max(1.5 * loss(theirs), 0.05)
    # loss, weights and their order are the learner's; a row of weight 3 counts as three rows
    x = np.array([r.features.toArray() for r in scaled.collect()])
    label, one, w = np.array([r.label for r in df.collect()]), np.ones(len(x)), net.weights.toArray()
    whole = perceptron.loss_and_gradient(w, net.getLayers(), x, label, one)
    assert whole[0] / len(x) == pytest.approx(loss(fitted), rel=1e-6, abs=1e-9)
    at = [i for i in range(len(x)) if i == 0 or tuple(x[i]) != tuple(x[i - 1])]
    n = np.array([float(r[3]) for r in rows])
    assert np.allclose(perceptron.loss_and_gradient(w, net.getLayers(), x[at], label[at], n), whole)
    for k in (0, 50, 500, len(w) - 1):
        step = np.zeros(len(w))
        step[k] = 1e-5
        up, down = (perceptron.loss_and_gradient(v, net.getLayers(), x, label, one)[0] for v in (w + step, w - step))
        assert (up - down) / 2e-5 == pytest.approx(whole[k + 1], rel=1e-3, abs=1e-6)


def test_the_acoustic_set_numbers_and_smooths_the_series_once(spark):
    files = ALL.queries["acoustic_functional_set"](spark, DATA).inputFiles()
    assert files and not any("events.parquet" in f for f in files)


@pytest.mark.parametrize("together", [16_000_000, 0])
def test_the_svc_takes_the_learners_steps(spark, monkeypatch, together):
    from sessiograph.operators import svc
    monkeypatch.setattr(svc, "TOGETHER", together)
    monkeypatch.setattr(svc, "BLOCK", 40)
    rng = random.Random(5)
    rows = []
    for i in range(90):
        label = int(rng.random() < 0.7)
        x = [1.0 if rng.random() < 0.5 else 0.0, rng.gauss(label, 1) if rng.random() < 0.4 else 0.0, 3.0, rng.gauss(0, 5), 0.0]
        at = [k for k, v in enumerate(x) if v]
        vector = Vectors.dense(x) if i % 3 else Vectors.sparse(5, at, [x[k] for k in at])
        rows.append((Vectors.sparse(5, {}) if i == 7 else vector, label, 0.5 + label, i % 3))
    df = spark.createDataFrame(rows, ["features", "label", "weight", "part"]).repartition(3)
    learner = LinearSVC(maxIter=40, tol=1e-6, regParam=0.01, weightCol="weight")
    got = svc.fit_svcs(df, learner, "part", 3)
    for i, m in enumerate(got):
        want = learner.fit(df.where(F.col("part") != i))
        assert [*m.coefficients, m.intercept] == pytest.approx([*want.coefficients, want.intercept], abs=1e-6)
    assert got[3].transform(df).select("prediction").distinct().count() == 2
    with pytest.raises(Exception, match="labels are 0 or 1"):
        svc.fit_svcs(df.withColumn("label", F.when(F.col("part") > 0, F.col("label"))), learner, "part", 3)


@pytest.mark.parametrize("share, categories", [("0.7", True), ("all", False)])
def test_trees_in_one_task_are_the_learners(spark, tmp_path, share, categories):
    from sessiograph.operators import boosting
    rng = random.Random(6)
    rows = [(rng.random() * 9, rng.random() * 5, rng.random() * 3, float(rng.randint(0, 1)), rng.random() + 0.5) for _ in range(200)]
    df = spark.createDataFrame([(*r[:3], float(r[0] > 4.5 and r[1] < 3 or r[3] > 0 and r[2] > 2), r[4]) for r in rows], ["a", "b", "c", "label", "weight"])
    names = ["a_range", "b_range", "c_range"]
    cut = Bucketizer(splitsArray=[[float("-inf"), *(k + 0.5 for k in range(8)), float("inf")]] * 3, inputCols=["a", "b", "c"], outputCols=names).transform(df)
    if not categories:
        cut = cut.select("label", "weight", *[(F.col(c) + 0.0).alias(c) for c in names])
    cut = cut.coalesce(1)
    gbt = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, minWeightFractionPerNode=0.02, maxBins=34, weightCol="weight", featureSubsetStrategy=share, seed=42).setProbabilityCol("p")
    rows = models.assemble(names).transform(cut)
    want, got = gbt.fit(rows), boosting.fit_trees(cut, names, gbt)
    assert got.treeWeights == want.treeWeights and got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    assert ("{" in got.toDebugString) == categories and got.toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]
    got.write().save(f"{tmp_path}/trees")
    again = GBTClassificationModel.load(f"{tmp_path}/trees")
    assert [r.p for r in again.transform(rows).collect()] == [r.p for r in want.transform(rows).collect()]
