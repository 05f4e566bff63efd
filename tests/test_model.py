"""Training data, the hold-out split, the model, its store and its attributions."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.operators import attributions, loans, model, scoring
from creditloom.plans import fixtures as fx


@pytest.fixture(scope="module")
def labelled(spark, sf):
    return loans.default_label(fx.loans(spark, sf)).cache()


@pytest.fixture(scope="module")
def stored(spark, labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "gbt")
    return model.load_or_train(spark, path, labelled, rounds=6), path


def test_split_is_exact_and_stable(labelled):
    split = loans.stratified_split(labelled)
    counts = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert len(counts) == 2 and all(t == int(n * 0.2 + 0.5) for n, t in counts.values())
    again = loans.stratified_split(labelled.repartition(7))
    assert split.select("loan_id", "is_test").exceptAll(again.select("loan_id", "is_test")).count() == 0
    other = loans.stratified_split(labelled, seed=1)
    assert split.select("loan_id", "is_test").exceptAll(other.select("loan_id", "is_test")).count() > 0


def test_weights_balance_classes(labelled):
    sums = [r.w for r in loans.balanced_weights(labelled).groupBy("label").agg(F.sum("weight").alias("w")).collect()]
    assert sums[0] == pytest.approx(sums[1]) and sum(sums) == pytest.approx(labelled.count())


def test_synthetic_loans(spark):
    made = loans.synth_loans(spark.range(5000)).cache()
    low = {"loan_amount": (50_000, 4_999_999), "interest_rate": (7, 24), "debt_to_income": (0, 45), "open_accounts": (1, 24), "total_accounts": (2, 39),
           "delinquency_two_years": (0, 3), "public_record": (0, 1), "total_revolving_credit_limit": (5_000, 299_999)}
    r = made.agg(*[F.min(c).alias(f"lo_{c}") for c in low], *[F.max(c).alias(f"hi_{c}") for c in low], F.avg("interest_rate").alias("m"),
                 F.avg("public_record").alias("p")).first()
    assert all(a <= r[f"lo_{c}"] and r[f"hi_{c}"] <= b for c, (a, b) in low.items())
    assert r.m == pytest.approx(15.5, abs=0.3) and r.p == pytest.approx(0.2, abs=0.03)
    assert made.exceptAll(loans.synth_loans(spark.range(5000).repartition(3))).count() == 0
    assert 0.2 < made.agg(F.avg("label")).first()[0] < 0.8


def test_class_report_counts(spark):
    pred = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 5 + [(0, 1)] * 1 + [(None, 1)], "label int, prediction int")
    got = {r["class"]: r for r in loans.class_report(pred).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.75, 0.75, 0.75, 4)
    assert got["accuracy"].f1 == 0.8 and got["macro avg"].recall == pytest.approx(0.7917, abs=1e-4)


def test_model_ranks_defaults(stored, labelled):
    fitted, _ = stored
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.holdout_predictions(fitted, labelled))
    assert auc > 0.97


def test_model_is_loaded_not_retrained(spark, stored):
    fitted, path = stored
    assert model.load_or_train(spark, path) is fitted
    model._models.clear()
    again = model.load_or_train(spark, path)
    assert again is not fitted and again.stages[-1].uid == fitted.stages[-1].uid


def test_interrupted_write_leaves_no_version(spark, stored, tmp_path, monkeypatch):
    """Without its marker a version does not count, is not written again, and the next one gets a number of its own."""
    fitted, _ = stored
    path = str(tmp_path / "store")
    fitted.save(f"{path}/version-00001")
    assert model.versions(spark, path) == []
    trained = []
    monkeypatch.setattr(model, "train_default_model", lambda data, rounds: trained.append(rounds) or fitted)
    assert model.load_or_train(spark, path, rounds=3).stages[-1].uid == fitted.stages[-1].uid
    assert trained == [3] and model.versions(spark, path) == [2]
    model.load_or_train(spark, path)
    assert trained == [3]
    assert model.save_version(fitted, spark, path) == 3 and model.versions(spark, path) == [2, 3]
    with pytest.raises(ValueError):
        model.load_version(spark, path, 1)


def test_damaged_file_is_not_replaced(spark, stored, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    model.save_version(stored[0], spark, path)
    files = [f for f in (tmp_path / "store").rglob("part-*") if "stages" in str(f) and f.suffix == ".parquet"]
    for f in files:
        f.write_bytes(b"not a table")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    monkeypatch.setattr(model, "train_default_model", lambda *a: pytest.fail("trained"))
    with pytest.raises(Exception, match="(?i)parquet|corrupt|FAILED_READ_FILE"):
        model.load_or_train(spark, path)
    assert files and all(f.read_bytes() == b"not a table" for f in files)


def test_scores_are_bounded(stored, spark, sf):
    out = model.score_loans(scoring.model_features(fx.loans(spark, sf), "loan_id"), stored[0])
    assert out.where("default_probability NOT BETWEEN 8 AND 80 OR abs(default_probability + ml_score - 100) > 1e-9").count() == 0
    assert out.count() == fx.loans(spark, sf).count()


def test_attributions_add_up(stored, spark, sf):
    fitted, path = stored
    features = scoring.model_features(fx.loans(spark, sf), "loan_id")
    wide = attributions.attributions_wide(features, fitted, path)
    raw = fitted.transform(features).select("loan_id", vector_to_array("rawPrediction")[1].alias("raw"))
    total = sum([F.col(c) for c in fv.MODEL_FEATURES], F.col("base"))
    assert wide.join(raw, "loan_id").agg(F.max(F.abs(total - F.col("raw")))).first()[0] < 1e-6


def test_leaf_contributions_equal_the_average_over_orders():
    path = {4: [-np.inf, 2.0, 0.3], 1: [1.0, np.inf, 0.6], 7: [0.0, 5.0, 0.25]}
    share = [b[2] for b in path.values()]
    other = attributions.contribution_tables(np.array([[0.5, 0.5, 0.5], share]), np.array([9.0, 2.0]))
    table = other[1].T
    for pattern in range(8):
        passed = [(pattern >> j) & 1 for j in range(3)]
        want = np.zeros(3)
        for order in permutations(range(3)):
            known: set[int] = set()
            value = lambda: 2.0 * np.prod([passed[j] if j in known else share[j] for j in range(3)])
            for j in order:
                before = value()
                known.add(j)
                want[j] += (value() - before) / 6
        assert table[pattern] == pytest.approx(want)
    rows = np.array([[9.0, 2.0, 9, 9, 1.0, 9, 9, 3.0], [9.0, 0.5, 9, 9, 2.5, 9, 9, 3.0]])
    leaf = attributions.Leaves(np.array([[4, 1, 7]]), *(np.array([[b[i] for b in path.values()]]) for i in range(3)), np.array([2.0]))
    got = attributions.contributions(rows, [leaf], [other[1:]])
    assert got[[4, 1, 7]].T == pytest.approx(np.array([table[7], table[4]])) and not got[[0, 2, 3, 5, 6]].any()


def test_factor_lists(spark):
    rows = [(1, f, round((i * 7 % 5 - 2) / 10, 1)) for i, f in enumerate(fv.MODEL_FEATURES)]
    top = attributions.top_factors(spark.createDataFrame(rows, "loan_id int, feature string, impact double").repartition(3))
    order = {f: i for i, f in enumerate(fv.MODEL_FEATURES)}
    risks = [r.feature for r in top.where("kind = 'risk'").orderBy("rank").collect()]
    positives = [r.feature for r in top.where("kind = 'positive'").orderBy("rank").collect()]
    assert risks == [f for _, f, _ in sorted(rows, key=lambda x: (-x[2], order[x[1]]))[:3]]
    assert positives == [f for _, f, _ in sorted(rows, key=lambda x: (x[2], order[x[1]]))[:3]]
    chart = {r.feature: r.type for r in attributions.factor_chart(top).collect()}
    assert chart == {f: "Risk" if v > 0 else "Positive" for _, f, v in rows if f in risks + positives}


def test_fallback_scores(spark):
    companies = spark.createDataFrame([(1,), (2,)], "company_id int")
    scores = spark.createDataFrame([(1, 20.0, 80.0, "LOW RISK")], "company_id int, default_probability double, ml_score double, recommendation string")
    got = {r.company_id: r for r in model.with_fallback(companies, scores).collect()}
    assert (got[1].default_probability, got[1].recommendation, got[1].risk_factors) == (20.0, "LOW RISK", None)
    assert (got[2].default_probability, got[2].ml_score, got[2].recommendation) == (35.0, 65.0, "MEDIUM RISK")
    assert [f.feature for f in got[2].risk_factors] == ["interest_rate", "debt_to_income", "public_record"]


def test_chart_in_the_row_equals_the_long_one(spark):
    import random

    from creditloom import fixedvalues as fv

    chance = random.Random(1)
    rows = [(i, *[chance.choice([-0.2, -0.1, 0.0, 0.1, 0.30004]) for _ in fv.MODEL_FEATURES]) for i in range(30)]
    wide = spark.createDataFrame(rows, "loan_id int, " + ", ".join(f"{f} double" for f in fv.MODEL_FEATURES))
    long = wide.unpivot("loan_id", fv.MODEL_FEATURES, "feature", "impact").withColumn("impact", F.round("impact", 4))
    want = attributions.factor_chart(attributions.top_factors(long)).select("loan_id", "feature", "impact", "type").collect()
    got = attributions.factor_chart_of_wide(wide).select("loan_id", "feature", "impact", "type").collect()
    rows = attributions.factor_chart_of_rows(long).select("loan_id", "feature", "impact", "type").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
