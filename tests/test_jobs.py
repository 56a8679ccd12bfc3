import bz2
import gzip
import os
import random

import pytest

from scribelens.functions.layout import stored
from scribelens.functions.ranking import rank_in_group, top_k
from scribelens.operators import topics as T
from scribelens.plans import jobs
from scribelens.plans.registry import all_queries
from scribelens.session import scratch, shared_dir
from scribelens.sources import xml_dump
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

HISTORY = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>A</title><ns>0</ns><id>10</id>
 <revision><id>1</id><timestamp>2011-05-05T13:00:00Z</timestamp>
  <contributor><username>u</username><id>5</id></contributor><text id="1" bytes="100" /></revision>
 <revision><id>2</id><timestamp>2012-01-01T00:00:00Z</timestamp>
  <contributor><username>u</username><id>5</id></contributor><comment>c</comment><text id="2" bytes="40" /></revision>
 <revision><id>3</id><timestamp>2011-05-06T00:00:00Z</timestamp>
  <contributor><username>u</username><id>5</id></contributor><minor /><text id="3" bytes="7" /></revision>
 <revision><id>4</id><timestamp>2011-05-06T00:00:00Z</timestamp>
  <contributor><ip>1.2.3.4</ip></contributor><text id="4" bytes="7" /></revision>
 <revision><id>5</id><timestamp>garbage</timestamp>
  <contributor><username>u</username><id>5</id></contributor><text id="5" bytes="7" /></revision>
 <revision><id>6</id><timestamp>2011-05-07T00:00:00Z</timestamp>
  <contributor><username>u</username><id>5</id></contributor><text id="6" /></revision>
</page>
<page><title>Talk:A</title><ns>1</ns><id>11</id>
 <revision><id>7</id><timestamp>2011-05-05T00:00:00Z</timestamp>
  <contributor><username>u</username><id>5</id></contributor><text bytes="9" /></revision></page>
</mediawiki>"""

ARTICLES = """<mediawiki>
<page><title>A</title><ns>0</ns><id>1</id><revision><id>1</id><text xml:space="preserve">Apples &amp; [[pear|pears]] grow apples</text></revision></page>
<page><title>B</title><ns>0</ns><id>2</id><revision><id>1</id><text>#REDIRECT [[A]]</text></revision></page>
<page><title>C</title><ns>0</ns><id>3</id><revision><id>1</id><text>pears </text></revision><revision><id>2</id><text>{{disambiguation}}</text></revision></page>
<page><title>D</title><ns>0</ns><id>4</id><revision><id>1</id><text>apples {{broken</text></revision></page>
<page><title>E</title><ns>0</ns><id>5</id><revision><id>1</id><text>pears {{disambiguation}} </text></revision></page>
</mediawiki>"""


def test_edit_tables(spark, tmp_path):
    with gzip.open(tmp_path / "history.xml.gz", "wt") as out:
        out.write(HISTORY)
    groups = spark.createDataFrame([(6, "bot")], "user_id BIGINT, user_group STRING")
    out = str(tmp_path / "edits")
    jobs.build_edit_tables(spark, str(tmp_path / "history.xml.gz"), groups, out, partitions=2)
    got = spark.read.parquet(out).select("split", "user_id", "article_id", "bytes", "n")
    assert sorted(tuple(r) for r in got.collect()) == [("test", 5, 10, 40, 1), ("training", 5, 10, 101, 2)]


def test_a_job_leaves_no_stored_tables(spark, tmp_path):
    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    with scratch(spark) as folder:
        kept = stored(spark.range(5), "five")
        assert kept.count() == 5 and os.listdir(folder)
    test_edit_tables(spark, tmp_path)
    assert set(os.listdir(shared)) == before


@pytest.mark.parametrize("packed", [True, False])
def test_a_page_with_very_many_revisions(spark, tmp_path, packed):
    """Read block by block: the ids of a page reach its revisions in other blocks."""
    one = "<revision><id>1</id><timestamp>2012-01-01T00:00:00Z</timestamp><contributor><id>{}</id></contributor><text bytes=\"3\" /></revision>\n"
    text = "<mediawiki>\n"
    for page, n in ((7, 30_000), (8, 1), (9, 30_000)):
        text += f"<page>\n<title>t</title>\n<ns>0</ns>\n<id>{page}</id>\n" + "".join(one.format(u + 1) for u in range(n)) + "</page>\n"
    text += "</mediawiki>\n"
    path = tmp_path / ("h.xml.gz" if packed else "h.xml")
    with (gzip.open(path, "wt") if packed else open(path, "w")) as out:
        out.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = xml_dump.read_history(spark, str(path))
        got = rows.groupBy("article_id", "ns").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.min("bytes").alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == [(7, 0, 30_000, 30_000, 3), (8, 0, 1, 1, 3), (9, 0, 30_000, 30_000, 3)]


def test_corpus(spark, tmp_path):
    (tmp_path / "articles.xml").write_text(ARTICLES)
    read = {r.article_id: r.text for r in xml_dump.read_articles(spark, str(tmp_path / "articles.xml")).collect()}
    assert read[3] == "pears {{disambiguation}}" and read[5].endswith(" ")
    out = str(tmp_path / "corpus")
    jobs.build_corpus(spark, str(tmp_path / "articles.xml"), out, 10)
    vocab = {r.idx: r.term for r in spark.read.parquet(f"{out}/vocabulary").collect()}
    vectors = {
        r.doc_id: {vocab[i]: v for i, v in zip(r.features.indices.tolist(), r.features.values)}
        for r in spark.read.parquet(f"{out}/vectors").collect()
    }
    assert vectors == {1: {"appl": 2.0, "pear": 1.0, "grow": 1.0}, 5: {"pear": 1.0}}
    assert [r.article_id for r in spark.read.parquet(f"{out}/quarantine").collect()] == [4]


def test_category_links(spark, tmp_path):
    (tmp_path / "c.sql").write_text("INSERT INTO `category` VALUES (1,'Fruit',0,0,0),(2,'Trees\\'',0,0,0);\n")
    (tmp_path / "l.sql").write_text(
        "INSERT INTO `categorylinks` VALUES (10,'Fruit','K','t','','u','page'),(11,'Trees\\'','K','t','','u','subcat'),"
        "(12,'Unknown','K','t','','u','page'),(13,'Fruit','K','t','','u','file');\n"
    )
    out = str(tmp_path / "links")
    jobs.build_category_links(spark, str(tmp_path / "c.sql"), str(tmp_path / "l.sql"), out)
    table = lambda name: [tuple(r) for r in spark.read.parquet(f"{out}/{name}").collect()]
    assert table("page") == [(10, 1)] and table("subcat") == [(11, 2)]
    assert table("page_unresolved") == [(12, "Unknown")] and table("subcat_unresolved") == []


def test_topic_model_round_trip(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    docs = [(i, Vectors.sparse(6, {(i % 2) * 3 + j: 5.0 for j in range(3)})) for i in range(20)]
    features = spark.createDataFrame(docs, ["doc_id", "features"])
    model = T.train_topics(features, 2, 20, seed=3)
    first = T.infer_topics(model, features)
    again = T.infer_topics(T.train_topics(features, 2, 20, seed=3), features)
    rows = lambda df: {(r.doc_id, r.topic): round(r.weight, 6) for r in df.collect()}
    assert rows(first) == rows(again)
    totals = first.groupBy("doc_id").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert all(t.s == pytest.approx(1.0) and t.n <= 5 for t in totals)
    T.save_topics(model, first, str(tmp_path / "lda"))
    loaded, stored = T.load_topics(spark, str(tmp_path / "lda"))
    assert rows(T.infer_topics(loaded, features)) == pytest.approx(rows(first)) and rows(stored) == rows(first)


def test_long_lists_are_cut_before_they_meet(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id")
    got = top_k(df, ["k"], [F.desc("id")], 1500)
    assert got.count() == 3000
    assert got.where("k = 1 AND rank = 1500").first().id == 4999 - 2 * 1499
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_short_lists_use_the_group_limit(spark):
    df = spark.range(50).selectExpr("id % 2 AS k", "id")
    plan = top_k(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rank_in_group(spark):
    df = spark.range(4000).selectExpr("id % 3 AS k", "id * 7 AS v")
    rows = rank_in_group(df, "k", "v").where("k = 1").orderBy("v").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", ["topic_recommend", "ground_truth", "user_knn", "revisions_clean", "blend"])
def test_no_cartesian_products(spark, name):
    plan = all_queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_filters_reach_the_scan(spark):
    plan = all_queries()["edits_for_user"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "bytes" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["articles.xml", "articles.xml.bz2"])
def test_articles_of_one_file_are_read_by_several_tasks(spark, tmp_path, name):
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id><revision><text>line\n  {1} &lt;page&gt;</text></revision></page>\n"
    noise = random.Random(1)
    texts = {i: " ".join(str(noise.random()) for _ in range(40)) for i in range(3000)}
    whole = "<mediawiki>" + "".join(page.format(i, t) for i, t in texts.items()) + "</mediawiki>"
    with (bz2.open(tmp_path / name, "wt") if name.endswith("bz2") else open(tmp_path / name, "w")) as out:
        out.write(whole)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "300k")
    try:
        read = xml_dump.read_articles(spark, str(tmp_path / name))
        rows = read.select("article_id", "title", "text", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.article_id: r.text for r in rows} == {i: f"line\n  {t} <page>" for i, t in texts.items()} and len(rows) == 3000
    assert len({r.task for r in rows}) > 1


def test_history_in_bz2_is_read_by_several_tasks(spark, tmp_path):
    noise = random.Random(2)
    revision = "<revision><id>{0}</id><timestamp>2011-05-05T13:00:00Z</timestamp><contributor><id>{1}</id></contributor><comment>{2}</comment><text bytes=\"{0}\" /></revision>"
    pages = "".join(
        f"<page><title>P</title><ns>0</ns><id>{p}</id>"
        + "".join(revision.format(p * 100 + r, r + 1, noise.random()) for r in range(100)) + "</page>"
        for p in range(1, 200)
    )
    with bz2.open(tmp_path / "h.xml.bz2", "wt") as out:
        out.write(f"<mediawiki>{pages}</mediawiki>")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "100k")
    try:
        assert spark.read.text(str(tmp_path / "h.xml.bz2")).rdd.getNumPartitions() > 1
        rows = xml_dump.read_history(spark, str(tmp_path / "h.xml.bz2")).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.article_id, r.user_id, r.bytes) for r in rows) == [(p, r + 1, p * 100 + r) for p in range(1, 200) for r in range(100)]
