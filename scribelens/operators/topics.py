"""Topic models and the recommender that matches user profiles with topic documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import DistributedLDAModel, LocalLDAModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import fan_out, stored
from scribelens.functions.ranking import stable, top_k
from scribelens.operators.topic_fit import BatchLDA, BlockLDA
from scribelens.operators.topic_inference import inference_table, inferred

TOP_TOPICS = 5
PRF_THRESHOLD = 20
CANDIDATE_FACTOR = 3
MATRIX = 1 << 22  # entries of a matrix in a task
GROUP_USERS = 8192  # users in a task, at most about
INFERRED = 1024  # documents inferred at once
STEP = 4  # a step of a topic list is so many times as long as the one before


def top_topics(distributions: DataFrame, top: int = TOP_TOPICS) -> DataFrame:
    """Strongest topics per document of (doc_id, weights ARRAY<DOUBLE>); ties by topic.

    Sorted inside the row: no shuffle, whatever the number of documents.
    """
    ranked = F.array_sort(
        F.transform("weights", lambda w, i: F.struct((-w).alias("key"), i.alias("topic")))
    )
    return distributions.select("doc_id", F.explode(F.slice(ranked, 1, top)).alias("t")).select(
        "doc_id", F.col("t.topic").alias("topic"), (-F.col("t.key")).alias("weight")
    )


def train_topics(
    vectors: DataFrame,
    topics: int = 400,
    iterations: int = 10,
    sample: float = 1.0,
    seed: int = 1,
    optimizer: str = "online",
):
    """Fit a topic model on a seeded sample of (doc_id, features).

    Expectation maximisation gives the model in its local form.
    """
    data = vectors if sample >= 1.0 else vectors.sample(False, sample, seed)
    kind = {"em": BlockLDA, "online": BatchLDA}[optimizer]
    lda = kind(
        k=topics,
        maxIter=iterations,
        optimizer=optimizer,
        seed=seed,
        optimizeDocConcentration=False,
        featuresCol="features",
    )
    return lda.fit(data)


def infer_topics(model, vectors: DataFrame, top: int | None = TOP_TOPICS, documents: int | None = None) -> DataFrame:
    """Assignments of any document set, also one the model was not trained on.

    The rows are those of `top_topics` over ``model.transform``, whose inference this repeats from
    the same start. It leaves out a document's vanished topics, soon nearly all of them. With
    ``top=None`` a document is assigned to all topics. With ``documents`` a task returns only the
    strongest ones of each topic among its own: all that `top_documents` can choose from.
    """
    spark = vectors.sparkSession
    table = spark.sparkContext.broadcast(inference_table(spark, model))
    kind = vectors.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "topic", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha, start = table.value
        strongest = None
        for batch in batches:
            for at in range(0, batch.num_rows, INFERRED):
                some = batch.slice(at, INFERRED)
                given = []
                for vector in some.column(1):
                    terms = vector["indices"].values  # none in a dense vector
                    given.append((None if terms is None else terms.to_numpy(), vector["values"].values.to_numpy(), start))
                found = inferred(given, beta, alpha)
                best = np.argsort(-found, axis=1, kind="stable")[:, :top]
                row = np.repeat(np.arange(len(best)), best.shape[1])
                weights = pa.array(np.take_along_axis(found, best, axis=1).ravel())
                columns = [some.column(0).take(pa.array(row)), pa.array(best.ravel().astype(np.int32)), weights]
                assigned = pa.RecordBatch.from_arrays(columns, names=names)
                if documents is None:
                    yield assigned
                else:
                    strongest = _strongest([assigned] if strongest is None else [*strongest.to_batches(), assigned], documents)
        if strongest is not None:
            yield from strongest.to_batches()

    return vectors.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, topic int, weight double")


def _strongest(batches: list[pa.RecordBatch], documents: int) -> pa.Table:
    """So many documents of each topic, in the order of `top_docs_per_topic`."""
    rows = pa.Table.from_batches(batches)
    keys = [("topic", "ascending"), ("weight", "descending"), ("doc_id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
    topic = rows["topic"].to_numpy()
    return rows.filter(pa.array(np.arange(len(topic)) - np.searchsorted(topic, topic) < documents)).combine_chunks()


def save_topics(model, assignments: DataFrame, path: str) -> None:
    save_topic_model(model, path)
    save_assignments(assignments, path)


def save_topic_model(model, path: str) -> None:
    """A model fitted by expectation maximisation is saved in its local form."""
    local = model.toLocal() if isinstance(model, DistributedLDAModel) else model
    local.write().overwrite().save(f"{path}/model")


def save_assignments(assignments: DataFrame, path: str) -> None:
    assignments.write.mode("overwrite").parquet(f"{path}/documents")


def load_topics(spark, path: str) -> tuple[LocalLDAModel, DataFrame]:
    return LocalLDAModel.load(f"{path}/model"), spark.read.parquet(f"{path}/documents")


def describe_topics(model, vocab: DataFrame, terms: int = 3) -> DataFrame:
    """Strongest terms per topic; ``vocab`` maps idx to term."""
    topics = model.describeTopics(terms)
    entries = topics.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "e")
    ).select(
        "topic",
        (F.col("pos") + 1).alias("rank"),
        F.col("e.termIndices").alias("idx"),
        F.col("e.termWeights").alias("weight"),
    )
    return entries.join(vocab, "idx").select("topic", "rank", "term", "weight")


def top_documents(assignments: DataFrame, documents: int = 3) -> DataFrame:
    """Strongest documents per topic of a fitted model: (topic, rank, doc_id, weight)."""
    return top_docs_per_topic(assignments, documents).select("topic", "rank", "doc_id", "weight")


def top_docs_per_topic(assignments: DataFrame, k: int) -> DataFrame:
    return top_k(assignments, ["topic"], [F.desc("weight"), F.col("doc_id")], k)


def topic_profile(history: DataFrame, assignments: DataFrame) -> DataFrame:
    """Summed topic weights over each user's distinct articles."""
    # One row per document with its few topics: the join is many-to-one, so AQE may split a
    # popular article freely, and only the small sums are shuffled again.
    per_doc = assignments.groupBy(F.col("doc_id").alias("article_id")).agg(
        F.collect_list(F.struct("topic", "weight")).alias("topics")
    )
    return (
        history.select("user_id", "article_id")
        .distinct()
        .join(per_doc, "article_id")
        .select("user_id", F.explode("topics").alias("t"))
        .groupBy("user_id", "t.topic")
        .agg(F.sum("t.weight").alias("weight"))
    )


def ranked_lists(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (topic, doc_id, doc_weight) laid out for reading by falling weight, and their steps.

    A document that is in ``lists`` of the topic lists scores at most ``lists`` times its largest
    contribution. So the entries of a topic are divided by that number, sorted by falling weight
    and cut into steps of growing length; a row of the second table has the largest and smallest
    weight of a step, and how many documents have their largest weight there. Both tables are
    bounded by the number of topics and of candidates per topic.
    """
    own = Window.partitionBy("doc_id")
    falling = [F.desc("doc_weight"), F.col("doc_id")]
    marked = candidates.select(
        "topic",
        "doc_id",
        "doc_weight",
        (F.row_number().over(own.orderBy(F.desc("doc_weight"), "topic")) == 1).alias("first"),
        F.count("*").over(own).alias("lists"),
        F.collect_list(F.struct("topic", "doc_weight")).over(own).alias("entries"),
    )
    place = F.row_number().over(Window.partitionBy("topic", "lists").orderBy(*falling))
    lists = stored(marked.withColumn("step", F.floor(F.log2(place) / F.log2(F.lit(STEP))).cast("int")), "lists")
    steps = lists.groupBy("topic", "lists", "step").agg(
        F.max("doc_weight").alias("high"), F.min("doc_weight").alias("low"), F.count_if("first").alias("firsts")
    )
    return lists, stored(steps, "steps")


def open_steps(profile: DataFrame, steps: DataFrame, seen: DataFrame | None, n: int) -> DataFrame:
    """The steps of the topic lists a user has to read to find the ``n`` best documents exactly.

    Read by falling contribution, steps are known to hold ever more documents that score at least
    the contribution of the step's last entry. Where they are ``n`` and as many as the user has
    seen (``seen``: user_id, _seen), that contribution is a bar that all the best reach. A step is
    left unread if even its first entry, counted once for every list its document is in, is below
    the bar. Columns: user_id, topic, weight, total, lists, step, bar.
    """
    every = Window.partitionBy("user_id")
    reached = profile.withColumn("total", F.sum("weight").over(every)).join(steps, "topic")
    wanted = F.lit(n)
    if seen is not None:
        reached = reached.join(seen, "user_id", "left")
        wanted = F.coalesce("_seen", F.lit(0)) + n
    falling = every.orderBy(F.desc("_low"), "topic", "lists", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = reached.withColumn("_low", F.col("weight") * F.col("low")).withColumn("_held", F.sum("firsts").over(falling))
    bar = F.max(F.when(F.col("_held") >= wanted, F.col("_low"))).over(every)
    # Scores are rounded to 9 digits, so the bar is lowered by more than that.
    barred = held.withColumn("bar", F.coalesce(bar, F.lit(0.0)) - F.lit(1e-8) * F.col("total"))
    return barred.where(F.col("weight") * F.col("high") * F.col("lists") >= F.col("bar")).select(
        "user_id", "topic", "weight", "total", "lists", "step", "bar"
    )


def _read(opened: DataFrame, lists: DataFrame) -> DataFrame:
    """The entries of the opened steps that can reach the bar."""
    entries = opened.join(lists, ["topic", "lists", "step"])
    return entries.where(F.col("weight") * F.col("doc_weight") * F.col("lists") >= F.col("bar"))


def _seen_candidates(known: DataFrame, lists: DataFrame) -> DataFrame:
    docs = lists.select(F.col("doc_id").alias("article_id")).distinct()
    return fan_out(known.select("user_id", "article_id").join(docs, "article_id", "left_semi"), "user_id")


def _scores(
    history: DataFrame, assignments: DataFrame, candidates: tuple[DataFrame, DataFrame], known: DataFrame | None, n: int
) -> DataFrame:
    """Exact scores of the candidates that can be among a user's ``n`` best; rows of ``known`` are
    taken out.

    A document in one topic list is scored by its entry. One in several is read once and meets
    the user's weights of all its topics.
    """
    lists, steps = candidates
    # From here on a user has at most one row per topic, so grouping by user is safe, and one
    # exchange serves the steps, the exclusion and the final ranking.
    profile = fan_out(topic_profile(history, assignments), "user_id")
    gone = counted = None
    if known is not None:
        gone = _seen_candidates(known, lists)
        counted = gone.groupBy("user_id").agg(F.count("*").alias("_seen"))
    read = _read(open_steps(profile, steps, counted, n), lists)
    article = F.col("doc_id").alias("article_id")
    part = (F.col("weight") * F.col("doc_weight") / F.col("total")).alias("part")
    alone = read.where("lists = 1").select("user_id", article, part)
    shared = (
        read.where("lists > 1")
        .groupBy("user_id", "doc_id")
        .agg(F.first("entries").alias("entries"), F.first("total").alias("total"))
        .select("user_id", "doc_id", "total", F.explode("entries").alias("e"))
        .select("user_id", "doc_id", "total", "e.topic", "e.doc_weight")
        .join(profile, ["user_id", "topic"])
        .select("user_id", article, part)
    )
    scored = alone.unionByName(shared).withColumn("_seen", F.lit(False))
    if gone is not None:
        taken = gone.select("user_id", "article_id", F.lit(0.0).alias("part"), F.lit(True).alias("_seen"))
        scored = scored.unionByName(taken)
    grouped = scored.groupBy("user_id", "article_id").agg(
        stable(F.sum("part")).alias("score"), F.max("_seen").alias("_seen")
    )
    return grouped.where("NOT _seen").drop("_seen")


def _scores_of_all(
    history: DataFrame, assignments: DataFrame, candidates: DataFrame, known: DataFrame | None, n: int
) -> DataFrame:
    """Scores of every candidate per user, of which the ``n`` best of each block of candidates are
    returned; rows of ``known`` are taken out.

    No row per user and candidate is formed: packed profiles of a group of users meet the matrix of
    a block of candidates. Profiles are stored, so that their number is known.
    """
    profile = topic_profile(history, assignments)
    users = profile.groupBy("user_id").agg(F.collect_list(F.struct("topic", "weight")).alias("topics"), F.sum("weight").alias("total"))
    if known is None:
        users = users.withColumn("seen", F.lit(None).cast("array<bigint>"))
    else:
        docs = candidates.select(F.col("doc_id").alias("article_id")).distinct()
        seen = known.join(docs, "article_id", "left_semi").groupBy(F.col("user_id").alias("_user"))
        seen = seen.agg(F.collect_list("article_id").alias("seen"))
        users = users.join(seen, F.col("user_id").eqNullSafe(F.col("_user")), "left").drop("_user")
    # Each topic's weight is its share of the user's, which Spark divides.
    share = F.transform("topics", lambda t: t["weight"] / F.col("total"))
    packed = users.select("user_id", F.col("topics.topic").alias("topics"), share.alias("shares"), "seen")
    packed = stored(packed, "profiles")
    size = candidates.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("topic").alias("topics")).first()
    blocks = max(1, -(-size.docs * size.topics // MATRIX))
    partitions = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(GROUP_USERS, MATRIX // n))
    count = packed.count()
    groups = max(-(-count // most), min(-(-partitions // blocks), -(-count // 64)), 1)
    left = packed.withColumn("g", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = candidates.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    kinds = dict(history.dtypes)["user_id"], dict(candidates.dtypes)["doc_id"]
    scored = (
        left.groupBy("b", "g")
        .cogroup(right.groupBy("b", "g"))
        .applyInArrow(_best_of_block(n), f"user_id {kinds[0]}, article_id {kinds[1]}, score double")
    )
    return scored.withColumn("score", stable(F.col("score")))


def _matrix(rows: np.ndarray, topics: np.ndarray, weights: np.ndarray, shape: tuple[int, int]):
    """Weights by row and topic, where there are any, and where they are not null."""
    null = np.isnan(weights)
    dense, some = np.zeros(shape), np.zeros(shape, np.float32)
    np.add.at(dense, (rows, topics), np.where(null, 0.0, weights))
    some[rows, topics] = 1
    valid = some
    if null.any():
        valid = np.zeros(shape, np.float32)
        valid[rows[~null], topics[~null]] = 1
    return dense, some, valid


def _best_of_block(n: int):
    def score(users: pa.Table, docs: pa.Table) -> pa.Table:
        found = []
        if users.num_rows and docs.num_rows:
            ids = pc.unique(docs["doc_id"].combine_chunks())
            ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))
            row = pc.index_in(docs["doc_id"].combine_chunks(), ids).to_numpy(zero_copy_only=False)
            topics, column = np.unique(docs["topic"].to_numpy(), return_inverse=True)
            items = _matrix(row, column, docs["doc_weight"].to_numpy(), (len(ids), len(topics)))
            step = max(1, min(512, MATRIX // (2 * len(ids))))
            for at in range(0, users.num_rows, step):
                part = users.slice(at, step).combine_chunks()
                user, doc, value = _best_of(part, items, ids, topics, n)
                found.append(
                    pa.table(
                        [part["user_id"].take(pa.array(user)), ids.take(pa.array(doc)), pa.array(value, from_pandas=True)],
                        names=["user_id", "article_id", "score"],
                    )
                )
        if found:
            return pa.concat_tables(found)
        empty = pa.array([], users.schema.field("user_id").type), pa.array([], docs.schema.field("doc_id").type)
        return pa.table([*empty, pa.array([], pa.float64())], names=["user_id", "article_id", "score"])

    return score


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a column of lists, and the entries."""
    whole = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(whole)), lengths), whole.flatten()


def _best_of(users: pa.Table, items: tuple, ids: pa.Array, topics: np.ndarray, n: int) -> tuple:
    """Row of the user, place of the document and score of the ``n`` best; ties by document."""
    dense, some, valid = items
    row, topic = _flat(users["topics"])
    weight = _flat(users["shares"])[1].to_numpy(zero_copy_only=False)
    topic = topic.to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(topics, topic), len(topics) - 1)
    here = topics[place] == topic
    own = _matrix(row[here], place[here], weight[here], (users.num_rows, len(topics)))
    # Unrounded here; as far as rounding to 9 digits decides, ties are kept by rounded score.
    value = own[0] @ dense.T
    key = np.round(value, 9)
    if own[2] is not own[1] or valid is not some:
        null = own[2] @ valid.T == 0
        value[null], key[null] = np.nan, -1e300
    # Where users and documents share no topic, and where the document is seen, there is no score.
    key[own[1] @ some.T == 0] = -np.inf
    if users["seen"].null_count < users.num_rows:
        row, seen = _flat(users["seen"])
        at = pc.index_in(seen.cast(ids.type), ids)
        held = at.is_valid().to_numpy(zero_copy_only=False)
        key[row[held], at.drop_null().to_numpy(zero_copy_only=False)] = -np.inf
    most = min(n, key.shape[1])
    bar = np.partition(key, -most, axis=1)[:, -most]
    row, column = np.nonzero((key >= bar[:, None]) & (key > -np.inf))
    order = np.lexsort((column, -key[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    row, column = row[keep], column[keep]
    return row, column, value[row, column]


def scoring_work(history: DataFrame, assignments: DataFrame, n: int = 10) -> DataFrame:
    """What `topic_recommend` forms per user in its last pass without feedback: ``steps`` looked at,
    ``entries`` formed, and ``candidates``, the entries of all lists of the user's topics."""
    known = history.select("user_id", "article_id").distinct()
    lists, steps = ranked_lists(_candidates(assignments, n))
    profile = fan_out(topic_profile(known, assignments), "user_id")
    counted = _seen_candidates(known, lists).groupBy("user_id").agg(F.count("*").alias("_seen"))
    read = _read(open_steps(profile, steps, counted, n), lists).groupBy("user_id").agg(F.count("*").alias("entries"))
    sizes = lists.groupBy("topic").agg(F.count("*").alias("_n"), F.countDistinct("lists", "step").alias("_steps"))
    whole = profile.join(sizes, "topic").groupBy("user_id").agg(F.sum("_steps").alias("steps"), F.sum("_n").alias("candidates"))
    return whole.join(read, "user_id")


def _candidates(assignments: DataFrame, n: int) -> DataFrame:
    """The best ``3n`` documents of every topic."""
    best = top_docs_per_topic(assignments, CANDIDATE_FACTOR * n)
    return best.select("topic", "doc_id", F.col("weight").alias("doc_weight"))


def topic_recommend(
    history: DataFrame,
    assignments: DataFrame,
    n: int = 10,
    prf: int = PRF_THRESHOLD,
    exclude_history: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """Documents of the topics a user edits, for all users of ``history`` at once.

    Users with fewer than ``prf`` articles are scored twice: their best first results join
    their history. Candidates are ``3n`` documents per topic of the model. By default a user
    meets them all; with ``bounded`` they are read by falling weight only as far as they can be
    among the best (see `open_steps`). Both give the same rows. Bounds form far fewer rows where
    topics differ in weight and few documents are in several lists, but order them in windows:
    measured on small tables they took two to three times as long.

    ``exclude_history=False`` keeps articles the user has edited already, as the original
    system did by accident.
    """
    # Both passes read the candidates; once stored, Spark knows their size and picks the join.
    candidates = stored(_candidates(assignments, n), "candidates")
    lists = ranked_lists(candidates) if bounded else None

    def scores(edits: DataFrame, seen: DataFrame | None, most: int) -> DataFrame:
        if lists is None:
            return _scores_of_all(edits, assignments, candidates, seen, most)
        return _scores(edits, assignments, lists, seen, most)

    known = history.select("user_id", "article_id").distinct()
    enriched = known
    if prf > 0:
        sizes = known.groupBy("user_id").agg(F.count("*").alias("_size")).where(F.col("_size") < prf)
        short = known.join(sizes, "user_id").drop("_size")
        first = scores(short, None, prf)
        feedback = (
            top_k(first, ["user_id"], [F.desc("score"), F.col("article_id")], prf, "_rank")
            .join(sizes, "user_id")
            .where(F.col("_rank") <= prf - F.col("_size"))
            .select("user_id", "article_id")
        )
        enriched = known.unionByName(feedback).distinct()
    scored = scores(enriched, known if exclude_history else None, n)
    return top_k(scored, ["user_id"], [F.desc("score"), F.col("article_id")], n)
