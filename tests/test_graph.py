import random
from collections import defaultdict
from pathlib import Path

import pytest

from scribelens.operators import categories as C
from scribelens.operators import closure as G
from scribelens.operators import similarity as S
from scribelens.plans.jobs import CategoryModel, build_category_model
from scribelens.session import scratch


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src BIGINT, dst BIGINT")


def brute_closure(rows):
    known = set(rows)
    while True:
        more = {(a, d) for a, b in known for c, d in rows if b == c} - known
        if not more:
            return known
        known |= more


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(
    "rows",
    [
        [(3, 2), (2, 1), (4, 1)],
        [(3, 2), (3, 2), (2, 1)],  # duplicate edges
        [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)],  # a cycle and a loop
        [(i, i + 1) for i in range(20)],  # deep
        sorted({(random.Random(i).randrange(15), random.Random(i + 50).randrange(15)) for i in range(22)}),
    ],
)
def test_closure(spark, rows):
    got = G.transitive_closure(edges(spark, *rows))
    assert found(got) == brute_closure(rows) and got.count() == len(found(got))


def test_self_pairs_once_per_category(spark):
    e = edges(spark, (3, 2), (2, 1))
    got = G.with_self(e, G.transitive_closure(e))
    assert found(got) == {(3, 2), (2, 1), (3, 1), (1, 1), (2, 2), (3, 3)} and got.count() == 6


def test_weights_count_articles_once(spark):
    e = edges(spark, (3, 2), (2, 1), (4, 1))
    links = spark.createDataFrame([(3, 10), (4, 10), (4, 11), (9, 12)], "category_id BIGINT, article_id BIGINT")
    members = C.article_categories(links, G.transitive_closure(e))
    got = {r.category_id: r.weight for r in C.category_weights(members).collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 2 / 3, 3: 2 / 3, 4: 1 / 3, 9: 2 / 3})


def brute_similarity(sets, weights, threshold):
    out = {}
    for a in sets:
        for b in sets:
            if a < b:
                common = sum(weights[c] for c in sets[a] & sets[b])
                either = sum(weights[c] for c in sets[a] | sets[b])
                if either > 0 and common / either >= threshold - 1e-9:
                    out[a, b] = common / either
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_similarity_with_hot_category_and_copies(spark, monkeypatch, threshold):
    monkeypatch.setattr(S, "CELL_ROWS", 7)  # lay hot categories out over many cells
    rng = random.Random(4)
    sets = {a: frozenset(rng.sample(range(12), rng.randint(1, 5))) | {0} for a in range(60)}
    sets.update({a: frozenset({0, 3, 5}) for a in range(60, 90)})  # a third are copies
    members = spark.createDataFrame(
        [(a, c) for a, cs in sets.items() for c in cs], "article_id BIGINT, category_id BIGINT"
    )
    count = defaultdict(int)
    for cs in sets.values():
        for c in cs:
            count[c] += 1
    weights = {c: 1 - n / len(sets) for c, n in count.items()}
    groups = S.article_sets(members)
    of = {r.article_id: r.set_id for r in groups.collect()}
    assert {a: min(b for b in sets if sets[b] == sets[a]) for a in sets} == of
    weighted = C.weighted_memberships(members, C.category_weights(members))
    similar = S.similar_sets(weighted, groups, threshold)
    rows = similar.collect()
    got = {(r.set_a, r.set_b): r.similarity for r in rows}
    assert len(got) == len(rows)
    want = brute_similarity({a: sets[a] for a in set(of.values())}, weights, threshold)
    want.update({(s, s): 1.0 for s in set(of.values()) if list(of.values()).count(s) > 1})
    assert got == pytest.approx(want)

    # Recommendations from the sets equal those from all pairs of articles.
    pairs = brute_similarity(sets, weights, threshold)
    # An article in weightless categories only is still similar to its copies.
    for a in sets:
        for b in sets:
            if a < b and sets[a] == sets[b]:
                pairs[a, b] = 1.0
    sims = defaultdict(dict)
    for (a, b), s in pairs.items():
        sims[a][b] = sims[b][a] = s
    history = {1: [60, 60, 61, 3], 2: [5, 9], 3: list(range(60, 90)), 4: [500]}
    frame = spark.createDataFrame([(u, a) for u, h in history.items() for a in h], "user_id BIGINT, article_id BIGINT")
    got = defaultdict(list)
    for r in C.category_recommend(frame, groups, similar, 7).orderBy("user_id", "rank").collect():
        got[r.user_id].append((r.article_id, pytest.approx(r.score, abs=1e-8)))
    for user, own in history.items():
        score = defaultdict(float)
        for a in own:
            for b, s in sims.get(a, {}).items():
                score[b] += s / len(own)
        best = sorted(((b, round(s, 9)) for b, s in score.items()), key=lambda x: (-x[1], x[0]))[:7]
        assert got[user] == best

    one = spark.createDataFrame([(3,)], "article_id BIGINT")
    near = {(r.article_id, r.similar_id) for r in S.similar_articles(similar, groups, one).collect()}
    assert near == {(3, b) for b in sims[3]}


def test_sets_meet_by_two_categories_where_one_is_frequent(spark):
    """Sets that all have one frequent category in their prefix, and few of which are similar."""
    rng = random.Random(9)
    sets = {a: frozenset({0, 1 + a % 20} | {100 + rng.randrange(60) for _ in range(4)}) for a in range(400)}
    rows = [(a, c, 1.0 if c < 100 else 0.9) for a, cs in sets.items() for c in cs]
    weighted = spark.createDataFrame(rows, "article_id BIGINT, category_id BIGINT, weight DOUBLE")
    groups = S.article_sets(weighted)
    different = S.similar_sets(weighted, groups, 0.6).where("set_a < set_b").collect()
    weights = {c: w for _, c, w in rows}
    heads = {r.set_id for r in groups.collect()}
    assert {(r.set_a, r.set_b): r.similarity for r in different} == pytest.approx(
        brute_similarity({a: sets[a] for a in heads}, weights, 0.6)
    )
    keys = S._keys(S._prefixes(weighted.withColumnRenamed("article_id", "set_id"), 0.6), 0.6)
    met = keys.groupBy("first", "second").count().selectExpr("sum(count * (count - 1) / 2) AS n").first().n
    assert met < 400 * 399 / 2 / 4


def test_sets_behind_enough_others_are_not_opened(spark):
    """A user near many sets: only as many as the list is long are opened, and ties keep their order."""
    members = [(10 * s + i, 10 * s, 5) for s in range(40) for i in range(5)]
    members = spark.createDataFrame(members, "article_id BIGINT, set_id BIGINT, n_articles BIGINT")
    similar = [(10 * s, 10 * s, 1.0) for s in range(40)] + [(10 * s, 10 * s + 10, 0.8) for s in range(0, 39, 2)]
    similar = spark.createDataFrame(similar, "set_a BIGINT, set_b BIGINT, similarity DOUBLE")
    own = [10 * s + (s % 3) for s in range(40)]
    history = spark.createDataFrame([(1, a) for a in own], "user_id BIGINT, article_id BIGINT")
    with scratch(spark) as folder:
        got = [(r.article_id, r.score) for r in C.category_recommend(history, members, similar, 4).orderBy("rank").collect()]
        opened = [spark.read.parquet(str(path)).count() for path in Path(folder).glob("opened-*")]
    score = {10 * s + i: round((1.8 - (10 * s + i in own)) / 40, 9) for s in range(40) for i in range(5)}
    assert got == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert opened and opened[0] <= 8


@pytest.mark.parametrize("sent", [0, 1 << 19])
def test_a_set_with_enough_articles_closes_those_of_lower_score(spark, monkeypatch, sent):
    """Rows equal those of all pairs, however sets and users meet; few sets are opened."""
    monkeypatch.setattr(C, "BROADCAST_SETS", sent)
    rng = random.Random(5)
    sizes = {100 * s: rng.choice([1, 2, 9]) for s in range(30)}
    sizes.update({3000: 12, 3100: 12, 3200: 12, 3300: 12})
    rows = [(s + i, s, k) for s, k in sizes.items() for i in range(k)]
    members = spark.createDataFrame(rows, "article_id BIGINT, set_id BIGINT, n_articles BIGINT")
    sims = {(s, s): 1.0 for s, k in sizes.items() if k > 1}
    sims.update({tuple(sorted(rng.sample(range(0, 3000, 100), 2))): rng.choice([0.5, 0.75]) for _ in range(60)})
    sims.update({(3000, 3100): 0.9, (3000, 3200): 0.8, (3000, 3300): 0.7})
    similar = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "set_a BIGINT, set_b BIGINT, similarity DOUBLE")
    articles = [a for a, s, _ in rows if s < 3000]
    history = {u: rng.choices(articles, k=1 + 3 * u) + [9999] for u in range(8)} | {50: [3000, 3000, 3001], None: articles[:3]}
    frame = spark.createDataFrame([(u, a) for u, h in history.items() for a in h], "user_id BIGINT, article_id BIGINT")
    with scratch(spark) as folder:
        found = C.category_recommend(frame, members, similar, 6).orderBy("user_id", "rank").collect()
        opened = [spark.read.parquet(str(path)).where("user_id = 50").count() for path in Path(folder).glob("opened-*")]
    assert opened == [1]
    of = {a: s for a, s, _ in rows}
    for user, own in history.items():
        score = defaultdict(float)
        for a in own:
            for b in of:
                if a in of and a != b:
                    score[b] += sims.get((min(of[a], of[b]), max(of[a], of[b])), 0.0) / len(own)
        best = sorted(((b, round(s, 9)) for b, s in score.items() if round(s, 9) > 0), key=lambda x: (-x[1], x[0]))[:6]
        got = [(r.article_id, pytest.approx(r.score, abs=1e-8)) for r in found if r.user_id == user]
        assert got == (best if user is not None else [])


def test_model_round_trip(spark, tmp_path):
    e = edges(spark, (3, 2), (2, 1))
    links = spark.createDataFrame(
        [(3, 10), (3, 11), (2, 12), (9, 12), (9, 13)], "category_id BIGINT, article_id BIGINT"
    )
    model = build_category_model(e, links, 0.3)
    model.save(str(tmp_path / "m"))
    again = CategoryModel.load(spark, str(tmp_path / "m"))
    assert found(again.similar) == found(model.similar) and found(again.members) == found(model.members)


def brute_classes(rows):
    pairs = brute_closure(rows)
    nodes = {n for r in rows for n in r}
    return {n: min([n, *(m for m in nodes if (n, m) in pairs and (m, n) in pairs)]) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_and_condensed_closure(spark, seed):
    rng = random.Random(seed)
    n = (6, 20, 40, 40)[seed]
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(n + 6 * seed)]
    classes = brute_classes(rows)
    closure = G.condensed_closure(edges(spark, *rows))
    assert found(closure.members) == set(classes.items()) and closure.members.count() == len(classes)
    assert found(closure.pairs()) == brute_closure(rows) and closure.pairs().count() == len(brute_closure(rows))
    assert found(closure.reach) == {(classes[a], classes[b]) for a, b in brute_closure(rows)}


def test_many_pairs_are_closed_by_classes(spark):
    rows = [(i, (i + 1) % 30) for i in range(30)] + [(7, 40), (40, 41)]
    assert found(G.transitive_closure(edges(spark, *rows), growth=3)) == brute_closure(rows)


def test_no_edges_have_no_closure(spark):
    none = edges(spark, (1, 2)).limit(0)
    assert G.transitive_closure(none).isEmpty() and G.condensed_closure(none).members.isEmpty()


def test_ring_of_many_nodes_is_one_class(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    closure = G.condensed_closure(ring)
    assert closure.members.where("component = 0").count() == n
    assert found(closure.reach) == {(0, 0)}


def test_weights_from_bitmaps(spark):
    rng = random.Random(6)
    tree = [(i, i // 2) for i in range(1, 30)]
    links = sorted({(rng.randrange(30), rng.choice([rng.randrange(50), 32768 * rng.randrange(1, 40)])) for _ in range(200)})
    e, l = edges(spark, *tree), spark.createDataFrame(links, "category_id BIGINT, article_id BIGINT")
    closure = G.transitive_closure(e)
    plain = C.category_weights(C.article_categories(l, closure))
    of = C.category_weights_of(l, closure)
    assert found(of.select("category_id", "n_articles")) == found(plain.select("category_id", "n_articles"))
    assert {r[0]: r[2] for r in of.collect()} == pytest.approx({r[0]: r[2] for r in plain.collect()})


def test_categories_of_articles_are_not_exchanged_as_pairs(spark):
    e = edges(spark, *[(i, i // 2) for i in range(1, 40)])
    rows = [(39, 7), (39, 7), (20, 7), (None, 8), (11, None), (50, 9)]
    l = spark.createDataFrame(rows, "category_id BIGINT, article_id BIGINT")
    got = C.article_categories(l, G.transitive_closure(e))
    up = lambda c: {c} | (up(c // 2) if c and c < 40 else set())
    want = [(a, c) for a, cs in {7: up(39) | up(20), 8: {None}, None: up(11), 9: {50}}.items() for c in cs]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("), ")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert keys and not any("article_id" in k and "category_id" in k for k in keys)


def test_weights_are_counted_without_bitmaps(spark):
    """A bitmap of 4 KB for every category and range of articles is more than the articles themselves."""
    e = edges(spark, (3, 2), (2, 1))
    links = [(3, 10), (2, 10), (3, 32768 * 50), (7, None), (None, 11)]
    l = spark.createDataFrame(links, "category_id BIGINT, article_id BIGINT")
    got = C.category_weights_of(l, G.transitive_closure(e))
    assert {r.category_id: r.n_articles for r in got.collect()} == {3: 2, 2: 2, 1: 2, 7: 0, None: 1}
    assert {r.category_id: r.weight for r in got.collect()} == pytest.approx({3: 1 / 3, 2: 1 / 3, 1: 1 / 3, 7: 1.0, None: 2 / 3})


def test_weights_are_not_gathered_as_bitmaps(spark, monkeypatch):
    def never(*_):
        raise AssertionError("bitmap")

    monkeypatch.setattr(C.F, "bitmap_construct_agg", never)
    e, l = edges(spark, (3, 2)), spark.createDataFrame([(3, 10)], "category_id BIGINT, article_id BIGINT")
    assert found(C.category_weights_of(l, G.transitive_closure(e)).select("category_id", "n_articles")) == {(3, 1), (2, 1)}


def test_weights_go_to_the_memberships(spark, monkeypatch):
    """Memberships are not exchanged by category, whatever Spark takes for small; beyond the bound they are."""
    members = spark.createDataFrame([(a, c) for a in range(20) for c in range(a % 5 + 1)], "article_id BIGINT, category_id BIGINT")
    want = {(a, c): 1 - (20 - 4 * c) / 20 for a in range(20) for c in range(a % 5 + 1)}
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for bound, sent in ((1 << 20, True), (1, False)):
            monkeypatch.setattr(C, "BROADCAST_WEIGHTS", bound)
            got = C.weighted_memberships(members, C.category_weights(members))
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == sent
            assert {(r.article_id, r.category_id): r.weight for r in got.collect()} == pytest.approx(want)
    finally:
        spark.conf.set(threshold, old)
