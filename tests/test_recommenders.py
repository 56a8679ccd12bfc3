import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from scribelens.operators import blend as B
from scribelens.operators import factors as M
from scribelens.operators import neighbours as N
from scribelens.operators import topics as T
from scribelens.operators.recommender import BlendRecommender, FixedLists
from scribelens.session import scratch

LISTS = "source STRING, user_id BIGINT, article_id BIGINT, score DOUBLE"


def ranked(df, user=None):
    out = defaultdict(list)
    for r in df.orderBy("user_id", "rank").collect():
        out[r.user_id].append((r.article_id, pytest.approx(r.score, abs=1e-8)))
    return out if user is None else out[user]


@pytest.fixture
def two_lists(spark):
    rows = [("a", 1, 1, 1.0), ("a", 1, 2, 0.5), ("b", 1, 1, 2.0), ("b", 1, 3, 0.5)]
    return spark.createDataFrame(rows, LISTS)


def test_weighted_blend(two_lists):
    got = ranked(B.blend(two_lists, 10, {"a": 1.0, "b": 2.0}), 1)
    assert got == [(1, 3.0), (2, 0.995), (3, 0.995)]


def test_default_blend(two_lists):
    assert ranked(B.blend(two_lists, 10), 1) == [(1, 2.0), (2, 0.7475), (3, 0.745)]
    assert [a for a, _ in ranked(B.blend(two_lists, 1), 1)] == [1]


def test_blend_ignores_a_source_without_positive_scores(spark):
    rows = [("a", 1, 1, 1.0), ("b", 1, 2, -1.0), ("b", 1, 3, -2.0)]
    assert ranked(B.blend(spark.createDataFrame(rows, LISTS), 10), 1) == [(1, 1.0)]


def test_blend_recommender(spark, two_lists, pairs):
    schema = "user_id BIGINT, article_id BIGINT, score DOUBLE, rank INT"
    a = FixedLists(spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 0.5, 2)], schema))
    b = FixedLists(spark.createDataFrame([(1, 1, 2.0, 1), (1, 3, 0.5, 2)], schema))
    both = BlendRecommender().add(a, 1.0).add(b, 2.0)
    users = pairs((1, 0)).select("user_id")
    assert ranked(both.recommend(pairs(), users), 1) == [(1, 3.0), (2, 0.995), (3, 0.995)]


# Topics


def brute_topics(history, assignments, n, prf, exclude):
    by_topic = defaultdict(list)
    for d, t, w in assignments:
        by_topic[t].append((-w, d))
    best = {t: sorted(v)[: 3 * n] for t, v in by_topic.items()}

    def score(docs):
        profile = defaultdict(float)
        for d, t, w in assignments:
            if d in docs:
                profile[t] += w
        total = sum(profile.values())
        out = defaultdict(float)
        for t, p in profile.items():
            for w, d in best[t]:
                out[d] += p * -w / total
        return sorted(((d, round(s, 9)) for d, s in out.items()), key=lambda x: (-x[1], x[0]))

    result = {}
    for user, docs in history.items():
        found = score(docs)
        if len(docs) < prf:
            found = score(docs | {d for d, _ in found[: prf - len(docs)]})
        if exclude:
            found = [f for f in found if f[0] not in docs]
        if found:
            result[user] = [(d, pytest.approx(s, abs=1e-8)) for d, s in found[:n]]
    return result


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("prf,exclude", [(20, True), (4, True), (20, False), (0, True)])
def test_topic_recommender(spark, pairs, prf, exclude, bounded):
    rng = random.Random(3)
    assignments = [(d, t, rng.random()) for d in range(60) for t in rng.sample(range(8), 3)]
    history = {u: {rng.randrange(70) for _ in range(rng.randint(1, 9))} for u in range(12)}
    history[99] = {65, 66}  # only documents the model does not know
    got = ranked(
        T.topic_recommend(
            pairs(*[(u, d) for u, docs in history.items() for d in docs], (0, next(iter(history[0])))),
            spark.createDataFrame(assignments, "doc_id BIGINT, topic INT, weight DOUBLE"),
            4,
            prf,
            exclude,
            bounded,
        )
    )
    assert got == brute_topics(history, assignments, 4, prf, exclude)


def test_top_topics_breaks_ties_by_topic(spark):
    df = spark.createDataFrame([(1, [0.1, 0.4, 0.4, 0.0, 0.05, 0.05, 0.0])], "doc_id BIGINT, weights ARRAY<DOUBLE>")
    assert [r.topic for r in T.top_topics(df).collect()] == [1, 2, 0, 4, 5]


# Factors


def factor_frames(spark, users, items):
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id BIGINT, features ARRAY<DOUBLE>")
    i = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(items)], "article_id BIGINT, features ARRAY<DOUBLE>")
    return u, i


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_factor_topk_matches_brute_force(spark, block):
    rng = np.random.default_rng(5)
    users = rng.normal(size=(30, 6))
    items = rng.normal(size=(90, 6)) * rng.lognormal(sigma=1.5, size=(90, 1))
    users[0] = 0.0
    got = ranked(M.factor_topk(*factor_frames(spark, users, items), 5, block))
    scores = np.round(users @ items.T, 9)
    for u in range(30):
        best = sorted(range(90), key=lambda j: (-scores[u, j], j))[:5]
        want = [(j, pytest.approx(scores[u, j], abs=1e-8)) for j in best if scores[u, j] >= 0]
        assert got[u] == want


def test_factor_topk_drops_negative_scores(spark):
    users, items = np.array([[1.0, 0.0]]), np.array([[1.0, 0.0], [-1.0, 0.0]])
    got = M.factor_topk(*factor_frames(spark, users, items), 2)
    assert [(r.article_id, r.rank) for r in got.collect()] == [(0, 1)]


def test_als_round_trip(spark, pairs, tmp_path):
    rng = random.Random(1)
    data = sorted({(u, (u + rng.randrange(4)) % 12) for u in range(20) for _ in range(6)})
    ratings = spark.createDataFrame(
        [(u, a, 1.0 + rng.random()) for u, a in data], "user_id BIGINT, article_id BIGINT, rating DOUBLE"
    )
    model = M.train_factors(ratings, rank=4, iterations=3)
    users = spark.createDataFrame([(0,), (1,), (777,)], "user_id BIGINT")
    first = ranked(M.recommend_factors(model, users, 3))
    assert set(first) == {0, 1}  # unknown users get no row
    M.save_factors(model, str(tmp_path / "als"))
    assert ranked(M.recommend_factors(M.load_factors(str(tmp_path / "als")), users, 3)) == first
    assert ranked(M.recommend_factors(M.train_factors(ratings, rank=4, iterations=3), users, 3)) == first


def test_many_factors_are_dealt_to_few_blocks(spark, monkeypatch):
    ratings = spark.range(200).selectExpr("id % 40 AS user_id", "id % 25 AS article_id", "1.0 + id % 3 AS rating")
    monkeypatch.setattr(M.ALS, "fit", lambda als, data: (als.getNumUserBlocks(), als.getNumItemBlocks()))
    assert M.train_factors(ratings) == (10, 10)
    monkeypatch.setattr(M, "FACTORS_SENT", 350)  # for 65 ids, or about as many
    assert M.train_factors(ratings) == (5, 5)
    monkeypatch.setattr(M, "FACTORS_SENT", 65)
    assert M.train_factors(ratings) == (M.LEAST_BLOCKS, M.LEAST_BLOCKS)
    assert M.train_factors(ratings, blocks=7) == (7, 7)


def test_ids_outside_int_range_fail(spark):
    ratings = spark.createDataFrame([(2**40, 1, 1.0)], "user_id BIGINT, article_id BIGINT, rating DOUBLE")
    with pytest.raises(Exception, match="32-bit"):
        M.train_factors(ratings, rank=2, iterations=1)


# Neighbours


def test_user_knn_matches_brute_force(spark):
    rng = random.Random(9)
    rated = {(u, rng.randrange(25)): float(rng.randint(1, 5)) for u in range(20) for _ in range(7)}
    rated.update({(u, 0): 1.0 for u in range(20)})  # one article everyone has
    edits = spark.createDataFrame(
        [(u, a, r) for (u, a), r in rated.items()], "user_id BIGINT, article_id BIGINT, rating DOUBLE"
    )
    active = spark.createDataFrame([(0,), (3,)], "user_id BIGINT")
    got = ranked(N.user_knn(edits, active, k=4, n=6))
    m = np.zeros((20, 25))
    for (u, a), r in rated.items():
        m[u, a] = r
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for u in (0, 3):
        sims = np.round(unit @ unit[u], 9)
        near = sorted((v for v in range(20) if v != u), key=lambda v: (-sims[v], v))[:4]
        scores = np.round(sims[near] @ m[near] / sims[near].sum(), 9)
        best = [a for a in sorted(range(25), key=lambda a: (-scores[a], a)) if m[u, a] == 0 and scores[a] > 0][:6]
        assert got[u] == [(a, pytest.approx(scores[a], abs=1e-8)) for a in best]
    assert N.hits(N.user_knn(edits, active, 4, 6), edits).where("n_hits > 0").isEmpty()


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_inference_leaves_out_vanished_topics(spark, monkeypatch, optimizer):
    """The rows of the model's own inference, without it."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rng = random.Random(4)
    data = [(d, Vectors.sparse(90, sorted((i, 1.0 + rng.randrange(4)) for i in rng.sample(range(90), 15)))) for d in range(40)]
    data += [(None, Vectors.dense([rng.randrange(3) for _ in range(90)])), (50, Vectors.sparse(90, [], [])), (3, data[3][1])]
    docs = spark.createDataFrame(data, ["doc_id", "features"])
    model = T.train_topics(docs, 200, 3, seed=7, optimizer=optimizer)
    own = model.transform(docs).select("doc_id", vector_to_array("topicDistribution").alias("weights"))
    wanted = sorted(map(tuple, T.top_topics(own).collect()), key=repr)
    monkeypatch.setattr(type(model), "transform", None)
    got = sorted(map(tuple, T.infer_topics(model, docs).collect()), key=repr)
    assert len(got) == 5 * 43 and [r[:2] for r in got] == [r[:2] for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], rel=1e-5)


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_strongest_documents_come_from_all_topics(spark, optimizer):
    """Also of topics that are among the five strongest of few documents or none."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rng = random.Random(6)
    data = [(d, Vectors.sparse(50, sorted((i, 1.0 + rng.randrange(4)) for i in rng.sample(range(50), 9)))) for d in range(60)]
    data += [(None, data[5][1]), (70, data[5][1]), (5, data[5][1]), (80, Vectors.sparse(50, [], []))]
    docs = spark.createDataFrame(data, ["doc_id", "features"]).repartition(3).cache()
    model = T.train_topics(docs, 40, 3, seed=7, optimizer=optimizer)
    every = T.infer_topics(model, docs, None)
    assert every.count() == 64 * 40
    own = model.transform(docs).select("doc_id", vector_to_array("topicDistribution").alias("weights"))
    wanted = T.top_documents(T.top_topics(own, 40), 3).orderBy("topic", "rank").collect()
    cut = T.infer_topics(model, docs, None, 3)
    assert cut.count() <= 3 * 3 * 40 and cut.exceptAll(every).isEmpty()
    got = T.top_documents(cut, 3).orderBy("topic", "rank").collect()
    assert len(got) == 3 * 40 and [r.weight for r in got] == pytest.approx([r.weight for r in wanted], rel=1e-5)
    assert T.top_documents(every, 3).exceptAll(T.top_documents(cut, 3)).isEmpty()


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_topic_models_reload(spark, tmp_path, optimizer):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(2)
    data = [(d, Vectors.sparse(12, sorted((i, 1.0 + rng.random()) for i in rng.sample(range(12), 5)))) for d in range(30)]
    docs = spark.createDataFrame(data, ["doc_id", "features"])
    model = T.train_topics(docs, 3, 4, optimizer=optimizer)
    T.save_topic_model(model, str(tmp_path))
    T.save_assignments(T.infer_topics(model, docs, 3), str(tmp_path))
    again, kept = T.load_topics(spark, str(tmp_path))
    assert kept.count() == 90 and T.infer_topics(again, docs, 3).count() == 90
    assert again.vocabSize() == 12 and again.topicsMatrix().toArray() == pytest.approx(model.topicsMatrix().toArray(), rel=1e-6)
    best = {(r.topic, r["rank"]): r.weight for r in T.top_documents(kept, 3).collect()}
    by_topic = {}
    for r in kept.collect():
        by_topic.setdefault(r.topic, []).append(r.weight)
    assert all(best[t, k + 1] == sorted(w, reverse=True)[k] for t, w in by_topic.items() for k in range(3))


def test_expectation_maximisation_in_blocks(spark, monkeypatch):
    """The model of `pyspark.ml`, whose own fit over a graph is not run."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors

    from scribelens.operators import topic_fit

    rng = random.Random(9)
    data = [(d, Vectors.sparse(40, sorted((i, 1.0 + rng.randrange(4)) for i in rng.sample(range(40), 1 + d % 20)))) for d in range(150)]
    data[7] = (7, Vectors.dense([rng.randrange(3) for _ in range(40)]))
    data += [(None, Vectors.sparse(40, [], [])), (3, data[3][1]), (160, Vectors.sparse(40, [2, 5], [0.0, 1e6]))]
    docs = spark.createDataFrame(data, ["doc_id", "features"]).repartition(5).cache()
    wanted = LDA(k=30, maxIter=6, optimizer="em", seed=3).fit(docs)
    for name, value in {"BLOCK": 16, "HELD": 2, "DRAWN": 3, "STEP": 4, "ROWS": 7, "FAN_IN": 2}.items():
        monkeypatch.setattr(topic_fit, name, value)
    monkeypatch.setattr(LDA, "_fit_java", None)
    model = T.train_topics(docs, 30, 6, seed=3, optimizer="em")
    assert model.topicsMatrix().toArray() == pytest.approx(wanted.topicsMatrix().toArray(), rel=1e-7)
    assert [r[:2] for r in model.describeTopics(3).collect()] == [r[:2] for r in wanted.describeTopics(3).collect()]
    assert list(model.estimatedDocConcentration()) == list(wanted.estimatedDocConcentration())


@pytest.mark.parametrize("together", [1, 500, 1 << 18])
def test_documents_are_inferred_together(monkeypatch, together):
    """However they meet, each document ends after its own number of steps, with all topics or few."""
    from scribelens.operators import topic_inference

    monkeypatch.setattr(topic_inference, "TOGETHER", together)
    monkeypatch.setattr(topic_inference, "HELD", 20 * together)
    rng = np.random.default_rng(3)
    beta = topic_inference.weights_of(rng.gamma(0.05, 40.0, (60, 90)) + 0.01)
    alpha, start = np.full(90, 1 / 90), rng.gamma(100.0, 0.01, 90)
    terms = [np.sort(rng.choice(60, 1 + d % 25, replace=False)) for d in range(40)] + [None, np.array([], int), np.array([3])]
    counts = [rng.integers(1, 6, 60 if t is None else len(t)).astype(float) for t in terms]
    counts[-1][:] = 0
    found = topic_inference.inferred([(t, c, start) for t, c in zip(terms, counts)], beta, alpha)
    for t, c, row in zip(terms, counts, found):
        own, gamma, change = beta if t is None else beta[t], start, 1.0
        while change > 1e-3:
            theta = np.exp(topic_inference.digamma(gamma) - topic_inference.digamma(gamma.sum()))
            last, gamma = gamma, theta * ((c / (own @ theta + 1e-100)) @ own) + alpha
            change = np.abs(gamma - last).mean()
        assert row == pytest.approx(gamma / gamma.sum() if c.any() else 0 * gamma, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("topics, seed", [(30, 3), (120, 2**40 + 7)])
def test_fit_from_batches(spark, monkeypatch, topics, seed):
    """The model of `pyspark.ml` with the optimizer "online", whose own fit is not run."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors

    rng = random.Random(9)
    data = [(d, Vectors.sparse(40, sorted((i, 1.0 + rng.randrange(4)) for i in rng.sample(range(40), 1 + d % 20)))) for d in range(150)]
    data[7] = (7, Vectors.dense([rng.randrange(3) for _ in range(40)]))
    data += [(None, Vectors.sparse(40, [], [])), (3, data[3][1]), (160, Vectors.sparse(40, [2, 5], [0.0, 7.0]))]
    docs = spark.createDataFrame(data, ["doc_id", "features"]).repartition(6).cache()
    wanted = LDA(k=topics, maxIter=6, optimizer="online", seed=seed, optimizeDocConcentration=False).fit(docs)
    monkeypatch.setattr(LDA, "_fit_java", None)
    model = T.train_topics(docs, topics, 6, seed=seed)
    assert model.topicsMatrix().toArray() == pytest.approx(wanted.topicsMatrix().toArray(), rel=1e-10)
    assert list(model.estimatedDocConcentration()) == list(wanted.estimatedDocConcentration())
    seeds = [m._java_obj.oldLocalModel().seed() for m in (model, wanted)]
    assert seeds[0] == seeds[1]


def test_stored_weights_are_exact_to_43_binary_digits():
    from scribelens.operators import topic_fit

    rng = np.random.default_rng(1)
    weights = 0.125 * (1 + np.exp(rng.uniform(-30, 20, (50, 8))))
    weights[0] = 0.125
    again = topic_fit._unpacked(topic_fit._packed(weights, 0.125), 8, 0.125)
    assert (again[0] == 0.125).all() and again == pytest.approx(weights, rel=2**-44)


# How much work the recommenders do


def test_topic_lists_are_read_only_as_far_as_needed(spark, pairs):
    """Users with a few strong topics among many: most entries of the others are never formed."""
    rng = random.Random(11)
    assignments = []
    for d in range(4000):
        topics = rng.sample(range(40), 3)
        assignments += [(d, t, w) for t, w in zip(topics, (0.5 + rng.random() / 2, 0.1 * rng.random(), 0.1 * rng.random()))]
    model = spark.createDataFrame(assignments, "doc_id BIGINT, topic INT, weight DOUBLE")
    history = pairs(*[(u, rng.randrange(4000)) for u in range(30) for _ in range(25)])
    work = T.scoring_work(history, model, 30).collect()
    assert len(work) == 30
    formed, whole = sum(r.steps + r.entries for r in work), sum(r.candidates for r in work)
    assert formed < whole / 3


def clustered(rng, n, clusters=40, width=0.05):
    """Vectors of length 1 around a few directions."""
    centres = rng.normal(size=(clusters, 16))
    found = centres[rng.integers(0, clusters, n)] + width * rng.normal(size=(n, 16))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def test_cones_prune_items_of_equal_norm(spark):
    rng = np.random.default_rng(3)
    items = clustered(rng, 3000)
    users = items[rng.integers(0, 3000, 60)]
    u, i = factor_frames(spark, users, items)
    got = ranked(M.factor_topk(u, i, 5, 64))
    scores = np.round(users @ items.T, 9)
    for k in range(60):
        best = sorted(range(3000), key=lambda j: (-scores[k, j], j))[:5]
        assert got[k] == [(j, pytest.approx(scores[k, j], abs=1e-8)) for j in best]
    assert M.open_share(u, i, 5, 64) < 0.25


def test_cones_hold_copies_and_zero_vectors(spark):
    """A third of the items are one vector, so one direction has several nodes."""
    rng = np.random.default_rng(4)
    items = rng.normal(size=(90, 4))
    items[::3] = items[0]
    items[1] = 0.0
    users = np.concatenate([rng.normal(size=(9, 4)), np.zeros((1, 4))])
    got = ranked(M.factor_topk(*factor_frames(spark, users, items), 12, 4))
    scores = np.round(users @ items.T, 9)
    for k in range(10):
        best = sorted(range(90), key=lambda j: (-scores[k, j], j))[:12]
        assert got[k] == [(j, pytest.approx(scores[k, j], abs=1e-8)) for j in best if scores[k, j] >= 0]


def test_users_are_sent_to_shelves_not_to_nodes(spark):
    """Independent directions of equal length: every node is open to every user."""
    rng = np.random.default_rng(4)
    items = rng.normal(size=(1500, 24))
    items /= np.sqrt((items * items).sum(axis=1))[:, None]
    users = rng.normal(size=(200, 24))
    with scratch(spark) as folder:
        got = ranked(M.factor_topk(*factor_frames(spark, users, items), 3, 8))
        written = sum(f.stat().st_size for f in Path(folder).glob("first-pass-*/*.parquet"))
    scores = np.round(users @ items.T, 9)
    for k in range(200):
        best = sorted(range(1500), key=lambda j: (-scores[k, j], j))[:3]
        assert got[k] == [(j, pytest.approx(scores[k, j], abs=1e-8)) for j in best if scores[k, j] >= 0]
    assert written < 20 * users.nbytes


def test_topic_scores_are_formed_in_blocks(spark, monkeypatch):
    """Only the best of a block leave it, not every pair of user and candidate; blocks change no row."""
    monkeypatch.setattr(T, "MATRIX", 300)
    rng = np.random.default_rng(8)
    rows = [(d, int(t), float(rng.random())) for d in range(150) for t in rng.choice(12, 5, replace=False)]
    assignments = spark.createDataFrame(rows, "doc_id BIGINT, topic INT, weight DOUBLE")
    edits = [(u, int(a)) for u in range(20) for a in rng.choice(150, 1 + 2 * u, replace=False)] + [(None, 3)]
    history = spark.createDataFrame(edits, "user_id BIGINT, article_id BIGINT")
    whole = T.topic_recommend(history, assignments, 30)
    assert whole.count() and whole.exceptAll(T.topic_recommend(history.where("user_id IS NOT NULL"), assignments, 30, bounded=True)).where(
        "user_id IS NOT NULL"
    ).isEmpty()
    assert whole.where("user_id IS NULL").count() == 30
    candidates = T._candidates(assignments, 50)
    formed = T._scores_of_all(history, assignments, candidates, history, 3)
    assert formed.groupBy("user_id").count().where("count > 3 * 6").isEmpty()
    seen = formed.join(history, ["user_id", "article_id"], "left_semi")
    assert seen.isEmpty()


def hot_edits(spark, users=300):
    """Groups of users with articles of their own, and one article that a third of all edits are of."""
    rng = random.Random(12)
    rows = {(u, 1000 * (u // 10) + 2 + rng.randrange(6)): 1.0 for u in range(users) for _ in range(6)}
    rows.update({(u, 0): 1.0 for u in range(users)})
    rows.update({(u, 1): 0.2 for u in range(0, users, 2)})
    return rows, spark.createDataFrame([(u, a, r) for (u, a), r in rows.items()], "user_id BIGINT, article_id BIGINT, rating DOUBLE")


@pytest.mark.parametrize("hot", [20, 100, 200, 10_000])
def test_neighbours_through_hot_articles(spark, hot):
    rated, edits = hot_edits(spark)
    columns = {a: j for j, a in enumerate(sorted({a for _, a in rated}))}
    m = np.zeros((300, len(columns)))
    for (u, a), r in rated.items():
        m[u, columns[a]] = r
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    active = spark.createDataFrame([(0,), (33,), (155,)], "user_id BIGINT")
    near = defaultdict(list)
    for r in N.neighbours(edits, active, k=5, hot=hot).orderBy("user_id", "rank").collect():
        near[r.user_id].append((r.neighbour_id, pytest.approx(r.similarity, abs=1e-8)))
    for u in (0, 33, 155):
        sims = np.round(unit @ unit[u], 9)
        assert near[u] == [(v, pytest.approx(sims[v], abs=1e-8)) for v in sorted((v for v in range(300) if v != u), key=lambda v: (-sims[v], v))[:5]]


def test_a_hot_article_forms_few_pairs(spark):
    _, edits = hot_edits(spark, 3000)
    active = spark.range(0, 3000, 100).selectExpr("id AS user_id")
    every = N.pairs_formed(edits, active, 5, hot=10**9)
    assert every > 30 * 2900 and N.pairs_formed(edits, active, 5, hot=100) < every / 10
