"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.layout import spread, stored
from scribelens.functions.validate import malformed
from scribelens.operators import articles as A
from scribelens.operators import blend as B
from scribelens.operators import categories as C
from scribelens.operators import closure as G
from scribelens.operators import corpus as K
from scribelens.operators import edits as E
from scribelens.operators import evaluate as V
from scribelens.operators import factors as M
from scribelens.operators import neighbours as N
from scribelens.operators import similarity as S
from scribelens.operators import topics as T
from scribelens.operators.recommender import BlendRecommender, FactorTables, TopicRecommender
from scribelens.plans import views as D
from scribelens.plans.jobs import build_category_model, evaluate, write_truth_vectors
from scribelens.session import shared_path
from scribelens.sinks import tables
from scribelens.sources import delimited, sql_dump, vectors, xml_dump

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE = 1000
SEED = 1
LIST_LENGTH = 5000
TOP = 10
SIMILARITY = 0.7

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r6(name: str | Column) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, 6)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def _list(name: str) -> Column:
    return F.array_join(name, " ")


# Edits -------------------------------------------------------------------------------------


@query
def revisions_parsed(spark, folder):
    return delimited.parse_revisions(D.revision_lines(spark, folder))


@query
def revisions_clean(spark, folder):
    path = shared_path(spark, "groups")
    tables.write_lines(D.group_lines(spark, folder), path)
    return E.clean_revisions(D.revisions(spark, folder), delimited.read_user_groups(spark, path))


@query
def revisions_xml(spark, folder):
    path = shared_path(spark, "history-xml")
    tables.write_pages(D.history_pages(spark, folder), path, "gzip")
    return xml_dump.read_history(spark, path)


@query
def revision_buckets(spark, folder):
    path = shared_path(spark, "buckets")
    tables.write_revision_buckets(D.order_revisions(spark, folder), path, 51, 51 * 400)
    return (
        spark.read.parquet(path)
        .groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("bytes").alias("bytes"),
            F.min("article_id").alias("first_article"),
            F.max("article_id").alias("last_article"),
        )
    )


@query
def edits_split(spark, folder):
    path = shared_path(spark, "split")
    edits = E.with_split(D.clean(spark, folder), D.SPLIT_DAY)
    tables.write_split(E.aggregate_edits(edits, "split"), path)
    return spark.read.parquet(path).select("split", "user_id", "article_id", "bytes", "n")


@query
def edits_aggregate(spark, folder):
    return E.aggregate_edits(D.order_revisions(spark, folder))


@query
def edits_count(spark, folder):
    return E.count_edits(D.order_revisions(spark, folder))


@query
def edits_flat(spark, folder):
    path = shared_path(spark, "edits")
    tables.write_csv(E.aggregate_edits(D.order_revisions(spark, folder)).select("user_id", "article_id", "bytes", "n"), path)
    return E.pairs(delimited.read_edits(spark, path))


@query
def edits_concat(spark, folder):
    first, second = shared_path(spark, "training"), shared_path(spark, "training")
    columns = ["user_id", "article_id", "bytes", "n"]
    tables.write_csv(E.aggregate_edits(D.order_revisions(spark, folder)).select(*columns), first)
    tables.write_csv(E.aggregate_edits(D.clean(spark, folder)).select(*columns), second)
    return delimited.read_edits(spark, first, second)


@query
def edits_by_user(spark, folder):
    bagged = E.bags(D.order_revisions(spark, folder))
    entry = F.transform(
        "articles", lambda a: F.concat_ws(":", a["article_id"].cast("string"), a["n"].cast("string"))
    )
    return bagged.select("user_id", "part", "n_edits", F.array_join(entry, ",").alias("articles"))


@query
def edits_articles(spark, folder):
    return E.articles(D.order_revisions(spark, folder))


@query
def edits_users(spark, folder):
    return E.users(D.order_revisions(spark, folder))


@query
def edits_for_user(spark, folder):
    training, test = D.order_training_test(spark, folder)
    return E.edits_of(training, V.sample_users(test, SAMPLE, SEED))


@query
def ratings(spark, folder):
    training, _ = D.training_test(spark, folder)
    return _rounded(E.ratings(training), "rating")


@query
def edits_strict(spark, folder):
    return delimited.parse_edits(D.edit_lines(spark, folder), on_error="drop")


@query
def edits_malformed(spark, folder):
    return delimited.malformed_edits(D.edit_lines(spark, folder))


@query
def every_nth_user(spark, folder):
    training, _ = D.order_training_test(spark, folder)
    return E.every_nth_user(training, 15).select("user_id", "article_id")


@query
def malformed_rows(spark, folder):
    return malformed(D.truth_lines(spark, folder), 2)


# Ground truth ------------------------------------------------------------------------------


def _truth(spark, folder):
    training, test = D.training_test(spark, folder)
    return training, stored(V.ground_truth(test, training), "truth")


@query
def ground_truth(spark, folder):
    return _truth(spark, folder)[1]


@query
def ground_truth_sparse(spark, folder):
    """A threshold so early that many users and articles are unknown."""
    training, test = D.training_test(spark, folder, "02.01.2024")
    return V.ground_truth(test, training)


@query
def ground_truth_parsed(spark, folder):
    return delimited.parse_truth(D.truth_lines(spark, folder), "drop")


# Topics ------------------------------------------------------------------------------------




@query
def top_topics(spark, folder):
    return _rounded(T.top_topics(D.distributions(spark, folder)), "weight")


@query
def top_docs_per_topic(spark, folder):
    return _rounded(T.top_docs_per_topic(D.assignments(spark, folder), 3 * TOP), "weight")


@query
def topic_profile(spark, folder):
    training, _ = D.training_test(spark, folder)
    return _rounded(T.topic_profile(training, D.assignments(spark, folder)), "weight")


def _topic_lists(spark, folder, n=TOP, **options):
    training, _ = D.training_test(spark, folder)
    return T.topic_recommend(training, D.assignments(spark, folder), n, **options)


@query
def topic_recommend(spark, folder):
    return _topic_lists(spark, folder)


@query
def topic_recommend_raw(spark, folder):
    return _topic_lists(spark, folder, exclude_history=False)


@query
def topic_recommend_prf(spark, folder):
    return _topic_lists(spark, folder, prf=40)


# Factors, neighbours, blend ----------------------------------------------------------------


@query
def factor_topk(spark, folder):
    users, items = D.factor_tables(spark, folder)
    return M.factor_topk(users, items, TOP)


@query
def user_knn(spark, folder):
    training, test = D.order_training_test(spark, folder)
    rated = training.select("user_id", "article_id", F.lit(1.0).alias("rating"))
    return N.user_knn(rated, V.sample_users(test, SAMPLE, SEED))


@query
def user_knn_hits(spark, folder):
    training, test = D.order_training_test(spark, folder)
    rated = training.select("user_id", "article_id", F.lit(1.0).alias("rating"))
    return N.hits(N.user_knn(rated, V.sample_users(test, SAMPLE, SEED)), test)


def _sources(spark, folder, n):
    users, items = D.factor_tables(spark, folder)
    return {
        "factor": M.factor_topk(users, items, n),
        "topic": _topic_lists(spark, folder, n),
    }


@query
def blend(spark, folder):
    lists = B.tagged(_sources(spark, folder, 3 * TOP))
    return B.blend(lists, TOP, {"factor": 1.0, "topic": 2.0})


# Evaluation --------------------------------------------------------------------------------


def _evaluation(spark, folder):
    training, truth = _truth(spark, folder)
    recommender = TopicRecommender(D.assignments(spark, folder))
    return evaluate(recommender, training, truth, SAMPLE, LIST_LENGTH, SEED)


_SHARES = ("precision", "average_precision", "recall", "f_measure")


@query
def eval_sample(spark, folder):
    return V.sample_users(_truth(spark, folder)[1], SAMPLE, SEED)


@query
def eval_metrics(spark, folder):
    metrics = _evaluation(spark, folder).metrics
    return _rounded(
        metrics.select("user_id", "n_recommended", "n_truth", "n_hits", *_SHARES), *_SHARES
    )


@query
def eval_recall_at(spark, folder):
    names = [f"recall_at_{k}" for k in V.CUTOFFS]
    return _rounded(_evaluation(spark, folder).metrics.select("user_id", *names), *names)


@query
def eval_summary(spark, folder):
    summary = _evaluation(spark, folder).summary()
    return _rounded(summary, *[c for c in summary.columns if c != "processed"])


@query
def eval_running(spark, folder):
    running = _evaluation(spark, folder).running()
    return _rounded(running, *[c for c in running.columns if c not in ("processed", "user_id")])


@query
def eval_end_to_end(spark, folder):
    """From the raw event log to the summary of a blend of two recommenders."""
    training, truth = _truth(spark, folder)
    users, items = D.factor_tables(spark, folder)
    recommender = (
        BlendRecommender()
        .add(FactorTables(users, items), 1.0)
        .add(TopicRecommender(D.assignments(spark, folder)), 2.0)
    )
    summary = evaluate(recommender, training, truth, SAMPLE, LIST_LENGTH, SEED).summary()
    return _rounded(summary, *[c for c in summary.columns if c != "processed"])


# Categories --------------------------------------------------------------------------------


@query
def category_edges(spark, folder):
    return delimited.parse_category_tree(D.tree_lines(spark, folder))


@query
def transitive_closure(spark, folder):
    return G.transitive_closure(D.cyclic_graph(spark, folder))


@query
def closure_reflexive(spark, folder):
    edges = D.tree(spark, folder)
    return G.with_self(edges, G.transitive_closure(edges))


def _memberships(spark, folder):
    return C.article_categories(D.links(spark, folder), G.transitive_closure(D.tree(spark, folder)))


@query
def article_categories(spark, folder):
    return _memberships(spark, folder)


@query
def category_weights(spark, folder):
    weights = C.category_weights_of(D.links(spark, folder), G.transitive_closure(D.tree(spark, folder)))
    return _rounded(weights, "weight")


@query
def article_category_weights(spark, folder):
    memberships = stored(_memberships(spark, folder), "memberships")
    weighted = C.weighted_memberships(memberships, C.category_weights(memberships))
    return _rounded(weighted, "weight")


def _category_model(spark, folder):
    return build_category_model(D.part_tree(spark, folder), D.part_links(spark, folder), SIMILARITY)


@query
def set_similarity(spark, folder):
    return _rounded(_category_model(spark, folder).similar, "similarity")


@query
def category_recommend(spark, folder):
    model = _category_model(spark, folder)
    history = D.order_revisions(spark, folder).select("user_id", "article_id")
    return C.category_recommend(history, model.members, model.similar, TOP)


@query
def sqldump_rows(spark, folder):
    fields = sql_dump.parse_tuples(D.link_dump(spark, folder)).select("fields")
    return fields.select(*[F.col("fields")[i].alias(f"f{i}") for i in range(7)])


def _dump_links(spark, folder):
    return sql_dump.category_links(D.link_dump(spark, folder))


@query
def links_split(spark, folder):
    parsed = stored(_dump_links(spark, folder), "links")
    other = C.other_links(parsed).withColumn("part", F.lit("other"))
    subcats = C.split_links(parsed, "subcat").select(
        "from_id", "to_name", F.lit("subcat").alias("kind"), F.lit("subcat").alias("part")
    )
    return other.union(subcats)


@query
def links_resolved(spark, folder):
    parsed = stored(_dump_links(spark, folder), "links")
    names = sql_dump.categories(D.category_dump(spark, folder))
    out = None
    for kind in ("page", "subcat"):
        wanted = C.split_links(parsed, kind)
        found = C.resolve_links(wanted, names).select(
            F.lit(kind).alias("kind"), "from_id", "category_id"
        )
        missing = C.unresolved_links(wanted, names).select(
            F.lit(kind).alias("kind"), "from_id", F.lit(None).cast("bigint").alias("category_id")
        )
        both = found.unionByName(missing)
        out = both if out is None else out.unionByName(both)
    return out


# Text --------------------------------------------------------------------------------------


def _documents(spark, folder):
    return spread(D.table(spark, folder, "documents")).select("doc_id", "text")


@query
def articles_xml(spark, folder):
    path = shared_path(spark, "articles-xml")
    tables.write_pages(D.article_pages(spark, folder), path)
    return xml_dump.read_articles(spark, path)


@query
def article_filter(spark, folder):
    return A.content_articles(D.articles(spark, folder)).select("article_id", "title", F.length("text").alias("n_chars"))


@query
def article_quarantine(spark, folder):
    return A.quarantine(A.content_articles(D.articles(spark, folder)))


@query
def wiki_tokens(spark, folder):
    tokens = A.wiki_tokens(A.content_articles(D.articles(spark, folder)), stem=False)
    return tokens.select("article_id", F.size("tokens").cast("bigint").alias("n_tokens"), _list("tokens").alias("tokens"))


@query
def html_tokens(spark, folder):
    tokens = A.html_tokens(spread(D.table(spark, folder, "pages")), stem=False)
    return tokens.select("page_id", F.size("tokens").cast("bigint").alias("n_tokens"), _list("tokens").alias("tokens"))


@query
def stem_vocabulary(spark, folder):
    return A.stem_vocabulary(A.wiki_tokens(A.content_articles(D.articles(spark, folder)), stem=False))


@query
def wiki_stems(spark, folder):
    stems = A.wiki_tokens(A.content_articles(D.articles(spark, folder)))
    return stems.select("article_id", F.size("tokens").alias("n_tokens"), _list("tokens").alias("stems"))


@query
def tokens(spark, folder):
    cut = A.tokenize(_documents(spark, folder))
    return cut.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), _list("tokens").alias("tokens"))


def _kept(spark, folder):
    return A.remove_stop_words(A.tokenize(_documents(spark, folder)))


@query
def tokens_no_stop(spark, folder):
    return _kept(spark, folder).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), _list("tokens").alias("tokens")
    )


@query
def vocabulary(spark, folder):
    vocab = K.vocabulary(_kept(spark, folder))
    return vocab.select(F.col("idx").cast("bigint").alias("idx"), "term", "n")


def _counts(spark, folder):
    kept = _kept(spark, folder)
    return K.term_counts(kept, K.vocabulary(kept))


@query
def term_counts(spark, folder):
    return _counts(spark, folder).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "count")


@query
def vocabulary_reread(spark, folder):
    """The vocabulary written as one line of one file and read back by the reader of such files."""
    path = shared_path(spark, "vocabulary-line")
    tables.write_single_file(tables.vocabulary_line(K.vocabulary(_kept(spark, folder))), path)
    return vectors.read_vocabulary(spark, path)


def _vectors(spark, folder):
    """Sparse vectors; one has at most as many entries as the vocabulary has terms."""
    entries = F.array_sort(F.collect_list(F.struct("idx", F.col("count").cast("double").alias("count"))))
    return (
        _counts(spark, folder)
        .groupBy("doc_id")
        .agg(entries.alias("e"))
        .select(
            "doc_id",
            F.lit(K.VOCABULARY_SIZE).alias("size"),
            F.col("e.idx").alias("indices"),
            F.col("e.count").alias("counts"),
        )
    )


@query
def doc_vectors_parsed(spark, folder):
    """Count vectors written as text lines and parsed back."""
    parsed = vectors.vector_entries(vectors.parse_vectors(tables.vector_lines(_vectors(spark, folder))))
    return parsed.select("doc_id", F.col("term_idx").cast("bigint").alias("idx"), "count")


@query
def docs_in_truth(spark, folder):
    """Stored vectors joined with the truth, written as lines and read back."""
    _, truth = _truth(spark, folder)
    path = shared_path(spark, "truth-vectors")
    write_truth_vectors(K.vector_store(_vectors(spark, folder)), truth, path)
    entries = vectors.vector_entries(vectors.read_vectors(spark, path))
    return entries.select("doc_id", F.col("term_idx").cast("bigint").alias("idx"), F.col("count").cast("bigint").alias("count"))


# Models ------------------------------------------------------------------------------------


@query
def vectorize_documents(spark, folder):
    docs = _documents(spark, folder)
    vectorized = K.vectorize(K.fit_text(docs), docs)
    filled = F.filter(vector_to_array("features"), lambda c: c > 0)
    return vectorized.select(
        "doc_id",
        F.size(filled).alias("n_terms"),
        F.aggregate(filled, F.lit(0.0), lambda s, c: s + c).alias("n_tokens"),
    )


def _features(spark, folder):
    docs = _documents(spark, folder)
    model = K.fit_text(docs)
    path = shared_path(spark, "vectors")
    tables.write_vectors(K.vectorize(model, docs), K.fitted_vocabulary(model, docs), path)
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/vocabulary")


@query
def lda_topics(spark, folder):
    features, _ = _features(spark, folder)
    return T.infer_topics(T.train_topics(features), features)


@query
def lda_sample(spark, folder):
    """Trained on a seeded sample, inferred for all documents."""
    features, _ = _features(spark, folder)
    return T.infer_topics(T.train_topics(features, sample=0.5), features)


@query
def top_documents(spark, folder):
    """Three strongest documents of each topic of a model fitted by expectation maximisation."""
    features, _ = _features(spark, folder)
    model = T.train_topics(features, optimizer="em")
    return T.top_documents(T.infer_topics(model, features, None, 3), 3)


@query
def lda_reload(spark, folder):
    """Saved model and assignments, and the documents inferred again by the loaded model."""
    features, _ = _features(spark, folder)
    model = T.train_topics(features)
    path = shared_path(spark, "lda")
    T.save_topics(model, T.infer_topics(model, features), path)
    loaded, stored = T.load_topics(spark, path)
    again = T.infer_topics(loaded, features).withColumnRenamed("weight", "again")
    return stored.join(again, ["doc_id", "topic"])


@query
def describe_topics(spark, folder):
    features, vocab = _features(spark, folder)
    model = T.train_topics(features, optimizer="em")
    return T.describe_topics(model, vocab, 3)


def _als(spark, folder):
    training, test = D.order_training_test(spark, folder)
    return M.train_factors(E.ratings(training)), V.sample_users(test, SAMPLE, SEED)


@query
def als_recommend(spark, folder):
    model, users = _als(spark, folder)
    return M.recommend_factors(model, users, TOP)


@query
def als_reload_recommend(spark, folder):
    model, users = _als(spark, folder)
    path = shared_path(spark, "als")
    M.save_factors(model, path)
    return M.recommend_factors(M.load_factors(path), users, TOP)
