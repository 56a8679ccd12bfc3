"""Every registered query with SQL against DuckDB, the others by their invariants."""

import os

import pytest
from pyspark.ml.clustering import LDA

from scribelens.plans import registry
from scribelens.plans.oracle import all_oracles
from scribelens.plans.registry import all_queries
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert difference(all_queries()[name](spark, FOLDER), con, ORACLES[name]) is None


def test_every_other_query_is_a_model_or_a_stemmer():
    assert set(all_queries()) - set(ORACLES) == {
        "als_recommend", "als_reload_recommend", "describe_topics", "lda_reload", "lda_sample", "lda_topics",
        "stem_vocabulary", "top_documents", "wiki_stems",
    }


def test_topics_are_distributions(spark):
    rows = all_queries()["lda_topics"](spark, FOLDER).collect()
    per_doc = {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r.weight)
    assert all(len(w) <= 5 and sum(w) <= 1 + 1e-6 for w in per_doc.values())


def test_reloaded_topics_are_equal(spark):
    rows = all_queries()["lda_reload"](spark, FOLDER).collect()
    assert rows and all(r.weight == pytest.approx(r.again, abs=1e-6) for r in rows)


def test_described_topics(spark):
    rows = all_queries()["describe_topics"](spark, FOLDER).collect()
    assert len(rows) == 3 * 400 and {r["rank"] for r in rows} == {1, 2, 3}


def test_every_topic_has_its_strongest_documents(spark):
    rows = all_queries()["top_documents"](spark, FOLDER).collect()
    assert len(rows) == 3 * 400 and {r["rank"] for r in rows} == {1, 2, 3}


def test_factor_lists_survive_reloading(spark):
    first = {(r.user_id, r["rank"]): r.article_id for r in all_queries()["als_recommend"](spark, FOLDER).collect()}
    again = {(r.user_id, r["rank"]): r.article_id for r in all_queries()["als_reload_recommend"](spark, FOLDER).collect()}
    assert first == again


def test_stems_cover_the_vocabulary(spark):
    rows = all_queries()["stem_vocabulary"](spark, FOLDER).collect()
    assert len({r.term for r in rows}) == len(rows) and all(r.stem and len(r.stem) <= len(r.term) for r in rows)


@pytest.mark.parametrize("name", ["lda_topics", "lda_sample", "lda_reload", "top_documents"])
def test_topic_queries_fit_as_many_topics_as_the_operator(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit(lda, data):
        raise Asked(lda.getK())

    monkeypatch.setattr(registry, "_features", lambda spark, folder: (spark.range(1), spark.range(1)))
    monkeypatch.setattr(LDA, "fit", fit)
    with pytest.raises(Asked) as asked:
        all_queries()[name](spark, FOLDER)
    assert asked.value.args == (400,)
