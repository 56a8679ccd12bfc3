import random

import numpy as np
import pytest

from scribelens.operators import evaluate as V
from scribelens.operators.recommender import FixedLists
from scribelens.plans.jobs import evaluate, evaluate_timed
from scribelens.sinks.tables import write_csv
from scribelens.sources import delimited as D

TRAINING = [(3, 1), (2, 2), (1, 3), (1, 4)]
TEST = [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (3, 4), (3, 5), (4, 6)]
TRUTH = [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (3, 4)]
EXPECTED = {1: (1.0, 1.0, 1.0), 2: (0.5, 1.0, 1 / 3), 3: (0.0, 0.0, 0.0)}


@pytest.fixture
def fixed(spark):
    lists = [(u, a, 1.0, a) for u in (1, 2, 3, 4) for a in (1, 2)]
    return FixedLists(spark.createDataFrame(lists, "user_id BIGINT, article_id BIGINT, score DOUBLE, rank INT"))


def check(evaluation):
    got = {r.user_id: (r.precision, r.average_precision, r.recall) for r in evaluation.metrics.collect()}
    assert got.keys() == EXPECTED.keys()
    for user, values in EXPECTED.items():
        assert got[user] == pytest.approx(values, abs=1e-3)


def test_ground_truth(pairs):
    truth = V.ground_truth(pairs(*TEST), pairs(*TRAINING))
    assert sorted(tuple(r) for r in truth.collect()) == TRUTH


def test_generated_truth(pairs, fixed):
    truth = V.ground_truth(pairs(*TEST), pairs(*TRAINING))
    check(evaluate(fixed, pairs(*TRAINING), truth))


def test_truth_from_file(spark, pairs, fixed, tmp_path):
    path = str(tmp_path / "truth")
    write_csv(pairs(*TRUTH), path)
    check(evaluate(fixed, pairs(*TRAINING), D.read_truth(spark, path)))


def test_malformed_truth_fails_when_evaluated(lines, pairs, fixed):
    truth = D.parse_truth(lines("1,1,0", "1,2", "2,1"))  # no error yet
    with pytest.raises(Exception, match="Data malformed"):
        evaluate(fixed, pairs(*TRAINING), truth).metrics.collect()


def test_users_without_lists_score_zero(spark, pairs):
    none = spark.createDataFrame([], "user_id BIGINT, article_id BIGINT, rank INT")
    metrics = V.user_metrics(none, pairs(*TRUTH), pairs(*TRUTH)).collect()
    assert len(metrics) == 3 and all(m.precision == m.recall == m.f_measure == 0.0 for m in metrics)


def test_recall_at(spark, pairs):
    lists = spark.createDataFrame(
        [(1, a, a) for a in range(1, 11)], "user_id BIGINT, article_id BIGINT, rank INT"
    )
    truth = pairs((1, 2), (1, 9), (1, 50), (1, 51))
    m = V.user_metrics(lists, truth, truth, (1, 5, 10)).first()
    assert (m.recall_at_1, m.recall_at_5, m.recall_at_10) == (0.0, 0.25, 0.5)
    assert m.average_precision == pytest.approx((1 / 2 + 2 / 9) / 2)


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x DOUBLE")
    assert df.agg(V.upper_median("x")).first()[0] == 3.0


def test_sample_is_exact_and_seeded(pairs):
    truth = pairs(*[(u, 1) for u in range(100)])
    first = [r.user_id for r in V.sample_users(truth, 10, 1).orderBy("position").collect()]
    again = [r.user_id for r in V.sample_users(truth, 10, 1).orderBy("position").collect()]
    other = {r.user_id for r in V.sample_users(truth, 10, 2).collect()}
    assert len(first) == 10 and first == again and set(first) != other
    assert V.sample_users(truth, 1000, 1).count() == 100


def test_report(pairs, fixed, tmp_path):
    truth = V.ground_truth(pairs(*TEST), pairs(*TRAINING))
    evaluation = evaluate(fixed, pairs(*TRAINING), truth)
    summary = evaluate_timed(evaluation, str(tmp_path / "report")).first()
    assert summary.processed == 3 and summary.total_ms > 0
    assert summary.avg_precision == pytest.approx(0.5)
    assert summary.median_precision == 0.5
    running = evaluation.running().orderBy("processed").collect()
    assert [r.processed for r in running] == [1, 2, 3]
    assert running[-1].avg_recall == pytest.approx(summary.avg_recall)


def upper(values):
    return sorted(values)[len(values) // 2] if values else None


@pytest.mark.parametrize("bins", [32, 1024])
def test_medians_by_histograms(spark, bins):
    rng = random.Random(bins)
    columns = {
        "same": [0.25] * 301,
        "few": [rng.choice([0.0, 0.5, 1.0]) for _ in range(301)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-3, 3) * rng.random() for _ in range(301)],
        "huge": [rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324]) for _ in range(301)],
        "close": [1.0 + i * 2**-52 for i in rng.sample(range(1000), 301)],
        "holes": [None if i % 3 else float(i) for i in range(301)],
        "none": [None] * 301,
    }
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} DOUBLE" for c in names)).repartition(3)
    want = {c: upper([v for v in vs if v is not None]) for c, vs in columns.items()}
    assert V.upper_medians(df, names, bins) == want
    assert V.upper_medians(df.limit(0), names, bins) == dict.fromkeys(names)


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_running_medians_of_blocks(spark, block):
    rng = random.Random(block)
    series = {
        "random": [rng.random() for _ in range(120)],
        "rising": [float(i) for i in range(120)],
        "falling": [float(-i) for i in range(120)],
        "steps": [float(rng.choice([0, 1]) + 5 * (i > 60)) for i in range(120)],
        "short": [0.5, 0.1, 0.9],
    }
    rows = [(m, i + 1, v) for m, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "name STRING, processed BIGINT, value DOUBLE").repartition(4)
    got = {(r["name"], r.processed): r.median for r in V.running_medians(df, block).collect()}
    assert got == {(m, i + 1): upper(vs[: i + 1]) for m, vs in series.items() for i in range(len(vs))}


def test_running_medians_of_many_users(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'m' AS name", "id + 1 AS processed", "pmod(xxhash64(id), 1000003) / 1000.0D AS value")
    got = V.running_medians(df, 4096).toPandas().set_index("processed")["median"]
    values = df.orderBy("processed").toPandas()["value"].to_numpy()
    assert len(got) == n
    for i in [1, 2, 4095, 4096, 4097, 77_777, 500_000, 999_999, n]:
        assert got[i] == np.sort(values[:i])[i // 2]


def test_running_report_of_several_blocks(spark):
    rng = random.Random(8)
    names = [*V.AVERAGED, *[f"recall_at_{k}" for k in V.CUTOFFS]]
    rows = [(u, *[rng.random() for _ in names]) for u in range(50)]
    metrics = spark.createDataFrame(rows, "user_id BIGINT, " + ", ".join(f"{m} DOUBLE" for m in names))
    # Every second position has no metrics.
    sample = spark.createDataFrame([(u, 2 * u + 1) for u in range(50)] + [(90 + u, 2 * u + 2) for u in range(50)], "user_id BIGINT, position INT")
    whole = {r.processed: r for r in V.running_report(metrics, sample, block=4096).collect()}
    cut = {r.processed: r for r in V.running_report(metrics, sample, block=4).collect()}
    assert whole.keys() == cut.keys() == set(range(1, 51))
    for i in range(1, 51):
        assert cut[i].user_id == whole[i].user_id == i - 1
        assert cut[i].median_recall == whole[i].median_recall == upper([r[1 + names.index("recall")] for r in rows[:i]])
        assert cut[i].avg_precision == pytest.approx(sum(r[1] for r in rows[:i]) / i)
