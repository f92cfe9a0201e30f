import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.operators import relational_models, scoring
from watchfold.operators.autoencoder import LAYERS, adam, gradient, initial_weights, squared_errors, train_autoencoder, unpack
from watchfold.operators.forest import anomaly, forest_arrays, train_forest, tree_samples
from watchfold.operators.training import benign_only, scale_by, seeded_sample
from watchfold.schema import FEATURES


@pytest.fixture(scope="module")
def normal(spark):
    draws = [(F.randn(i) * 0.1 + 0.5).alias(c) for i, c in enumerate(FEATURES)]
    rows = spark.range(3000, numPartitions=4).select(F.col("id").cast("string").alias("id"), *draws).collect()
    return spark.createDataFrame(rows)


def test_weight_count_and_gradient():
    w = initial_weights()
    assert len(w) == 1969 == sum(a * b + b for a, b in zip(LAYERS[:-1], LAYERS[1:], strict=True)) and len(unpack(w)) == 6
    x = np.random.default_rng(0).uniform(size=(16, 9))
    g, eps = gradient(x, w), 1e-6
    for i in (0, 300, 1000, 1500, 1968):
        step = np.zeros_like(w)
        step[i] = eps
        slope = (squared_errors(x, w + step).mean() - squared_errors(x, w - step).mean()) / (2 * eps)
        assert g[i] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_samples_are_exact_and_repeatable(normal):
    a = tree_samples(normal, trees=20).groupBy("tree").count().collect()
    assert len(a) == 20 and {r["count"] for r in a} == {256}
    first = sorted(train_forest(normal, trees=5).collect())
    assert first == sorted(train_forest(normal.repartition(7), trees=5).collect())


def test_forest_ranks_planted_outliers(normal):
    forest = forest_arrays(train_forest(normal, trees=60))
    x = np.array([[0.5] * 9, [0.55] * 9, [1.5] * 9, [0.5] * 8 + [3.0]])
    s = anomaly(x, forest)
    assert s[:2].max() < s[2:].min() and s[:2].max() < 0.5 < s[2]


def test_store_load_score(spark, normal, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        scoring.load(spark, path)
    scoring.train(normal, path)
    model = scoring.load(spark, path)
    odd = spark.createDataFrame([("odd", *[0.5] * 8, 9.0)], ["id", *FEATURES])
    s = scoring.score(normal.unionByName(odd), model)
    top = s.orderBy(F.desc("anomaly_score")).first()
    assert top.id == "odd" and len(top.top_features) == 3 and top.top_features[0]["name"] == "geo_velocity_kmh"
    assert s.filter("anomaly_score < 0 or anomaly_score > 1").count() == 0
    limit = scoring.contamination_threshold(scoring.score(normal, model))
    flagged = scoring.with_outlier_flag(s, limit).filter("is_outlier").count()
    assert 15 <= flagged <= 45
    grid = scoring.benign_error_grid(s)
    assert s.filter("id = 'odd'").select(scoring.error_percentile(grid)).first()[0] == 1.0


def test_sample_and_benign(spark):
    rows = spark.range(500).withColumn("line_id", F.col("id").cast("string"))
    a = {r.id for r in seeded_sample(rows, 50).collect()}
    assert len(a) == 50 and a == {r.id for r in seeded_sample(rows.repartition(5), 50).collect()}
    flows = spark.createDataFrame([("BENIGN",), (" BENIGN ",), ("DDoS",)], [" Label"])
    assert benign_only(flows).count() == 2 and benign_only(flows.filter("` Label` = 'DDoS'")).count() == 1


def test_scaling_skips_empty_columns(spark):
    df = spark.createDataFrame([tuple([2.0] * 9)], FEATURES)
    r = scale_by(df, {**dict.fromkeys(FEATURES, 4.0), "tod_zscore": 0.0}).first()
    assert r.event_count_1m == 0.5 and r.tod_zscore == 2.0


def test_steps_use_gradient_sums_over_all_rows(normal):
    batch = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(2))
    x = {b: np.array([list(r) for r in normal.filter(batch == b).select(*FEATURES).collect()]) for b in (0, 1)}
    state = {"w": initial_weights(42), "t": 0, "m": 0.0, "v": 0.0}
    for epoch in range(2):
        for b in np.random.default_rng([42, epoch]).permutation(2).tolist():
            adam(gradient(x[b], state["w"]), state, 0.001)
    for parts in (1, 7):
        assert train_autoencoder(normal.repartition(parts), epochs=2, steps=2) == pytest.approx(state["w"], abs=1e-9)


def test_epochs_as_one_stage_and_as_single_jobs_agree(spark, normal, monkeypatch):
    """The two ways of running a step give the same weights, also with fewer rows than tasks."""
    one = train_autoencoder(normal, epochs=1, steps=3)
    few = train_autoencoder(normal.limit(5), epochs=2, steps=3, batch=2)
    from watchfold.operators import autoencoder as A

    def by_jobs(rows, order, state, rate):
        for b in order.tolist():
            g = A.mean_gradient(rows.filter(F.col("_b") == b).select(*FEATURES), state["w"])
            if g is not None:
                adam(g, state, rate)
        return state
    monkeypatch.setattr(A, "_epoch_in_one_stage", by_jobs)
    assert train_autoencoder(normal, epochs=1, steps=3) == pytest.approx(one, abs=1e-9)
    assert train_autoencoder(normal.limit(5), epochs=2, steps=3, batch=2) == pytest.approx(few, abs=1e-9)


def test_a_step_is_one_job_without_waiting_tasks(normal, monkeypatch):
    """A barrier stage waits about a second at each exchange; by default every step is a job of its own, of equal weights."""
    from watchfold.operators import autoencoder as A
    steps, whole = [], A.mean_gradient
    monkeypatch.setattr(A, "mean_gradient", lambda rows, weights: steps.append(1) or whole(rows, weights))
    jobs = train_autoencoder(normal, epochs=2, steps=3)
    assert len(steps) == 6
    assert train_autoencoder(normal, epochs=2, steps=3, one_stage=True) == pytest.approx(jobs, abs=1e-9)
    assert len(steps) == 6 and whole(normal.limit(0).select(*FEATURES), jobs) is None


def test_forest_scores_do_not_depend_on_blocks(normal, monkeypatch):
    from watchfold.operators import forest as f
    trees, x = forest_arrays(train_forest(normal, trees=20)), np.random.default_rng(3).uniform(size=(f.BLOCK + 7, 9))
    x[5, 2] = np.nan
    at = np.tile(trees["roots"], (len(x), 1))
    for _ in range(int(trees["depth"])):
        left = x[np.arange(len(x))[:, None], trees["feature"][at]] <= trees["threshold"][at]
        at = np.where(left, trees["left"][at], trees["right"][at])
    walked = np.power(2.0, -trees["path"][at].mean(axis=1) / trees["norm"][0])
    assert np.array_equal(anomaly(x, trees), walked) and len(anomaly(x[:0], trees)) == 0
    assert np.array_equal(np.concatenate([anomaly(row[None], trees) for row in x]), walked)


def test_models_are_fitted_on_all_rows(spark, monkeypatch):
    from watchfold.plans import model_queries as q
    seen = []
    monkeypatch.setattr(q.scoring, "train", lambda rows, path: seen.append(rows.count()))
    monkeypatch.setattr(q.scoring, "load", lambda spark, path: None)
    monkeypatch.setattr(q.scoring, "score", lambda rows, model: rows)
    monkeypatch.setattr(q.scoring, "contamination_threshold", lambda rows: seen.append(rows.count()))
    monkeypatch.setattr(q.scoring, "with_outlier_flag", lambda rows, limit: rows.withColumn("anomaly_score", F.lit(0)).withColumn("is_outlier", F.lit(0)))
    rows = spark.range(10_500).withColumn("id", F.col("id").cast("string"))
    q.trained_on_events(spark, rows)
    q.trained_on_events(spark, rows, sample=50)
    monkeypatch.setattr(q, "activity", lambda spark, sf: None)
    monkeypatch.setattr(q, "flow_rows", lambda rows: None)
    flows = spark.range(11_000).select(F.col("id").cast("string").alias("line_id"), F.lit("BENIGN").alias("Label"))
    monkeypatch.setattr(q, "flow_features", lambda flow: flows)
    q.flow_scores(spark, None)
    assert seen == [10_500, 50, 11_000, 11_000]


def test_layers_of_a_given_autoencoder_are_generated_code(spark):
    """Only the nine errors and their sum go through lambdas, not the products of the layers."""
    weights, maxima = relational_models.given_weights(), dict.fromkeys(FEATURES, 2.0)
    values = [[(7 * i + 3 * j) % 11 / 5 for j in range(9)] for i in range(20)]
    rows = spark.createDataFrame([(str(i), *v) for i, v in enumerate(values)], "id string, " + ", ".join(f"{c} double" for c in FEATURES))
    out = relational_models.reconstruct(rows, weights, maxima)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "transform(" not in plan
    expected = squared_errors(np.array(values) / 2, weights)
    got = {r.id: r.recon_errors for r in out.collect()}
    assert np.allclose([got[str(i)] for i in range(20)], expected)
