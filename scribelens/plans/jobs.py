"""The end-to-end jobs a user runs: dumps to tables, corpus to vectors, models to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.operators import articles as A
from scribelens.operators import categories as C
from scribelens.operators import closure as G
from scribelens.operators import corpus
from scribelens.operators import edits as E
from scribelens.operators import evaluate as V
from scribelens.operators import similarity as S
from scribelens.operators.recommender import Recommender
from scribelens.session import scratch
from scribelens.sinks import tables
from scribelens.sources import sql_dump, xml_dump


def build_edit_tables(
    spark: SparkSession,
    history_path: str,
    user_groups: DataFrame,
    out: str,
    threshold: str = E.DEFAULT_SPLIT,
    partitions: int | None = None,
) -> None:
    """Revision dump to training and test aggregates: one plan with one shuffle for the sums."""
    with scratch(spark):
        history = xml_dump.read_history(spark, history_path, partitions)
        edits = E.with_split(E.clean_revisions(history, user_groups), threshold)
        tables.write_split(E.aggregate_edits(edits, "split"), out)


def build_corpus(
    spark: SparkSession, articles_path: str, out: str, size: int = corpus.VOCABULARY_SIZE
):
    """Article dump to count vectors, vocabulary and the table of articles left out."""
    articles = A.content_articles(xml_dump.read_articles(spark, articles_path))
    tokens = A.wiki_tokens(articles).select(
        F.col("article_id").alias("doc_id"), F.array_join("tokens", " ").alias("text")
    )
    # Read by the vocabulary count and again by the vectors; a table is cheaper than parsing
    # the markup twice and survives the loss of an executor.
    tokens.write.mode("overwrite").parquet(f"{out}/tokens")
    tokens = spark.read.parquet(f"{out}/tokens")
    model = corpus.fit_text(tokens, size)
    tables.write_vectors(
        corpus.vectorize(model, tokens), corpus.fitted_vocabulary(model, tokens), out
    )
    A.quarantine(articles).write.mode("overwrite").parquet(f"{out}/quarantine")
    return model


def write_truth_vectors(store: DataFrame, truth: DataFrame, path: str) -> None:
    """Lines ``id;vector`` of the stored vectors (`corpus.vector_store`) of the documents in the truth."""
    tables.write_vector_lines(corpus.documents_in_truth(store, truth), path)


def build_category_links(
    spark: SparkSession, category_path: str, link_path: str, out: str, encoding: str = "UTF-8"
) -> None:
    """SQL dumps to page links, sub-category links and the links that name no category."""
    names = sql_dump.categories(sql_dump.read_lines(spark, category_path, encoding))
    with scratch(spark):
        # Parsed once, read for every kind.
        links = stored(sql_dump.category_links(sql_dump.read_lines(spark, link_path, encoding)), "links")
        for kind in ("page", "subcat"):
            wanted = C.split_links(links, kind)
            C.resolve_links(wanted, names).write.mode("overwrite").parquet(f"{out}/{kind}")
            C.unresolved_links(wanted, names).write.mode("overwrite").parquet(f"{out}/{kind}_unresolved")


@dataclass
class CategoryModel:
    """Sets of articles with equal categories, and the similar pairs among the sets."""

    members: DataFrame
    similar: DataFrame

    def save(self, path: str) -> None:
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        self.similar.write.mode("overwrite").parquet(f"{path}/similar")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CategoryModel:
        return CategoryModel(
            spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/similar")
        )


def build_category_model(edges: DataFrame, links: DataFrame, threshold: float) -> CategoryModel:
    """Tree (src, dst) and links (category_id, article_id) to similar articles."""
    memberships = stored(C.article_categories(links, G.transitive_closure(edges)), "memberships")
    weighted = C.weighted_memberships(memberships, C.category_weights(memberships))
    members = stored(S.article_sets(memberships), "members")
    similar = stored(S.similar_sets(weighted, members, threshold), "similar")
    return CategoryModel(members, similar)


@dataclass
class Evaluation:
    """Metrics per user; summary and running report are derived from them."""

    sample: DataFrame
    metrics: DataFrame
    cutoffs: tuple[int, ...] = V.CUTOFFS

    def summary(self) -> DataFrame:
        return V.summary(self.metrics, self.cutoffs)

    def running(self) -> DataFrame:
        return V.running_report(self.metrics, self.sample, self.cutoffs)


def evaluate(
    recommender: Recommender,
    training: DataFrame,
    truth: DataFrame,
    num: int = 1000,
    n: int = 5000,
    seed: int = 1,
    cutoffs: tuple[int, ...] = V.CUTOFFS,
) -> Evaluation:
    """Recommend ``n`` articles to ``num`` sampled users and score the lists, in one plan.

    ``truth`` comes from `ground_truth` or from a file.
    """
    sample = stored(V.sample_users(truth, num, seed), "sample")
    lists = recommender.recommend(training, sample.select("user_id"), n)
    return Evaluation(sample, V.user_metrics(lists, truth, sample, cutoffs), cutoffs)


def evaluate_timed(evaluation: Evaluation, path: str) -> DataFrame:
    """Run an evaluation, store its tables and add the wall-clock time to the summary.

    All users are served by one job, so the time per user is the mean.
    """
    import time

    spark = evaluation.metrics.sparkSession
    start = time.monotonic()
    tables.write_report(evaluation.metrics, f"{path}/metrics")
    took = (time.monotonic() - start) * 1000.0
    stored = Evaluation(evaluation.sample, spark.read.parquet(f"{path}/metrics"), evaluation.cutoffs)
    tables.write_report(stored.running(), f"{path}/running")
    summary = stored.summary().withColumn("total_ms", F.lit(took))
    summary = summary.withColumn("avg_ms", F.try_divide("total_ms", "processed"))
    tables.write_report(summary, f"{path}/summary")
    return spark.read.parquet(f"{path}/summary")
