"""Category tree: ancestors of articles, category weights, link resolution, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import bucket_count, bucketed, fan_out, stored
from scribelens.functions.ranking import SCORE_DIGITS, rank_in_group, stable, top_k


BROADCAST_WEIGHTS = 1 << 20  # rows of a table of weights that is sent to every executor, at most
BROADCAST_SETS = 1 << 19  # rows of a table of sets, likewise


def _categories_of(links: DataFrame, closure: DataFrame) -> DataFrame:
    """(article_id, categories): the distinct categories an article is below or directly in.

    A link carries the list of its category's ancestors, so what is exchanged is a row per link,
    and pairs of article and ancestor are made distinct inside the article's row.
    """
    # The struct keeps what is null in the list.
    above = closure.groupBy(F.col("src").alias("_category")).agg(F.collect_list(F.struct("dst"))["dst"].alias("_above"))
    own = F.array("category_id")
    lists = fan_out(links, "category_id").join(above, F.col("category_id") == F.col("_category"), "left").select(
        "article_id", F.when(F.col("_above").isNull(), own).otherwise(F.concat(own, "_above")).alias("_list")
    )
    return lists.groupBy("article_id").agg(F.array_distinct(F.flatten(F.collect_list("_list"))).alias("categories"))


def article_categories(links: DataFrame, closure: DataFrame) -> DataFrame:
    """Every (article, category) where the article is below the category or directly in it."""
    return _categories_of(links, closure).select("article_id", F.explode("categories").alias("category_id"))


def category_weights(memberships: DataFrame) -> DataFrame:
    """1 − share of articles under the category.

    Keyed by category and divided by the number of distinct articles (the original counted
    per article and divided by the number of links).
    """
    total = memberships.select(F.countDistinct("article_id")).scalar()
    return (
        memberships.groupBy("category_id")
        .agg(F.count("*").alias("n_articles"))
        .select("category_id", "n_articles", (1 - F.col("n_articles") / total).alias("weight"))
    )


def category_weights_of(links: DataFrame, closure: DataFrame) -> DataFrame:
    """`category_weights` of (article_id, category_id) links and the closure of the tree.

    No pair of article and ancestor is exchanged: every task counts the lists of its articles, and
    what meets are its counts, one per category. The row without category counts all articles.
    """
    every = F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast(dict(links.dtypes)["category_id"]).alias("category_id")))
    each = F.transform("categories", lambda c: F.struct(F.lit(False).alias("all"), c.alias("category_id")))
    counted = (
        _categories_of(links, closure)
        .select("article_id", F.explode(F.concat(every, each)).alias("c"))
        .groupBy("c.all", "c.category_id")
        .agg(F.count("article_id").alias("n_articles"))
    )
    counted = stored(counted, "counts")
    total = counted.where("all").agg(F.coalesce(F.sum("n_articles"), F.lit(0))).first()[0]
    return counted.where("NOT all").select("category_id", "n_articles", (1 - F.col("n_articles") / F.lit(total)).alias("weight"))


def weighted_memberships(memberships: DataFrame, weights: DataFrame) -> DataFrame:
    """Memberships with the weight of their category.

    The weights are stored, so that their number is known: up to a bound they go to the
    memberships, which are not exchanged.
    """
    side = stored(weights.select("category_id", "weight"), "weights")
    if side.count() <= BROADCAST_WEIGHTS:
        side = F.broadcast(side)
    return memberships.join(side, "category_id").select("article_id", "category_id", "weight")


def split_links(links: DataFrame, kind: str) -> DataFrame:
    """Links of one kind (``page`` or ``subcat``)."""
    return links.where(F.col("kind") == kind).select("from_id", "to_name")


def other_links(links: DataFrame) -> DataFrame:
    """Everything but sub-category links, with its kind."""
    return links.where(F.col("kind") != "subcat").select("from_id", "to_name", "kind")


def resolve_links(links: DataFrame, categories: DataFrame) -> DataFrame:
    """Links with the id of their target category."""
    return links.join(categories, links.to_name == categories.name).select("from_id", "category_id")


def unresolved_links(links: DataFrame, categories: DataFrame) -> DataFrame:
    return links.join(categories, links.to_name == categories.name, "left_anti")


def category_recommend(
    history: DataFrame, members: DataFrame, similar: DataFrame, n: int = 10
) -> DataFrame:
    """Articles by their mean similarity to a user's articles.

    Works on sets of articles with equal categories (see `similarity`), so a large group of
    copies costs one row per user instead of one per copy. Articles of a set differ only where
    the user has edited them; its first ``n`` plus as many as the user has edited therefore
    hold every article of the set that can reach the top ``n``. The articles of a set that the
    user has not edited have the set's score, and come before all rows of sets with a lower one;
    of sets with the same score the first article does. So sets behind ``n`` such rows are not
    opened, and one behind fewer only as far as it counts.

    Edits are exchanged once by user, and stored so: all that follows stays there, if the sets
    near each other and the first articles of the sets are few enough to be sent.
    """
    spark = history.sparkSession
    edited = _edited_sets(history, members)
    near, few = _near_sets(members, similar)
    per_set = edited.where("set_id IS NOT NULL").groupBy("user_id", "set_id").agg(
        F.sum("_own").alias("_rows"),
        F.count("*").alias("_edited"),
        F.max((F.col("article_id") == F.col("set_id")) & (F.col("n_articles") > 1)).alias("_lowered"),
        F.max("_n").alias("_n"),
    )
    met = per_set.join(F.broadcast(near) if few else near, F.col("set_id") == F.col("set_a"))
    met = met if few else fan_out(met, "user_id")
    own = F.col("similarity").isNull()
    sets = met.groupBy("user_id", F.col("set_b").alias("set_id")).agg(
        F.sum(F.col("_rows") * F.col("similarity")).alias("_sum"),
        F.max("_n").alias("_n"),
        F.max(F.when(own, F.col("_edited"))).alias("_edited"),
        F.coalesce(F.max(F.when(own, F.col("_lowered"))), F.lit(False)).alias("_lowered"),
        F.max("_size").alias("_size"),
        F.max("_copies").alias("_copies"),
    )
    scored = sets.withColumn("_score", stable(F.col("_sum") / F.col("_n"))).where("_score > 0")
    # Rows that certainly have the set's score, and of those the one before all of later sets with it.
    whole = F.col("_size") - F.when(F.col("_copies"), F.coalesce("_edited", F.lit(0))).otherwise(0)
    scored = scored.withColumns(
        {
            "_whole": F.greatest(whole, F.lit(0)),
            "_first": F.when(F.col("_lowered"), 0).otherwise(1),
            "_place": (-F.round(F.col("_score") * 10**SCORE_DIGITS)).cast("bigint"),
        }
    )
    by_user = Window.partitionBy("user_id")
    better = by_user.orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
    before = by_user.orderBy("_place", "set_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda rows, window: F.coalesce(F.sum(rows).over(window), F.lit(0))
    opened = bucketed(
        scored.withColumn("_need", n - ahead("_whole", better) - ahead("_first", before) + ahead("_first", better))
        .where("_need > 0")
        .withColumn("_lowered", F.coalesce(F.sum("_edited").over(by_user), F.lit(0)))
        .select("user_id", "set_id", "_score", "_sum", "_n", "_need", "_edited", "_lowered"),
        "opened",
        bucket_count(spark),
        "user_id",
    )
    # Only the first n of a set meet the users near it. Users who edited in the set meet the
    # further members in the places of those they edited, beyond n up to as many more.
    ranked = rank_in_group(members.select("set_id", "article_id", "n_articles"), "set_id", "article_id", "_pos")
    first = stored(ranked.where(F.col("_pos") <= n), "first-articles")
    sent = first.count() <= BROADCAST_SETS
    further = opened.where(F.col("_need") + F.col("_edited") > n).select(
        "user_id", "set_id", "_sum", "_n", F.explode(F.sequence(F.lit(n + 1), F.col("_edited") + F.col("_need"))).alias("_pos")
    )
    reached = opened.join(F.broadcast(first) if sent else first, "set_id").where(
        F.col("_pos") <= F.col("_need") + F.coalesce("_edited", F.lit(0))
    )
    # Only an article that the user has edited can score less than its set, so n rows and as many
    # more as those hold the best.
    place = F.row_number().over(by_user.orderBy(F.desc("_score"), "article_id"))
    reached = (reached if sent else fan_out(reached, "user_id")).withColumn("_at", place).where(F.col("_at") <= n + F.col("_lowered"))
    columns = ["user_id", "article_id", "n_articles", "_sum", "_n"]
    expanded = (
        reached.select(*columns)
        .unionByName(further.join(ranked, ["set_id", "_pos"]).select(*columns))
        .join(edited.where("set_id IS NOT NULL").select("user_id", "article_id", "_own"), ["user_id", "article_id"], "left")
    )
    # A copy group contains the user's own article; an article is not similar to itself.
    own = F.when(F.col("n_articles") > 1, F.coalesce("_own", F.lit(0))).otherwise(F.lit(0))
    scored = expanded.select(
        "user_id", "article_id", stable((F.col("_sum") - own) / F.col("_n")).alias("score")
    ).where("score > 0")
    return top_k(scored, ["user_id"], [F.desc("score"), F.col("article_id")], n)


def _edited_sets(history: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, article_id, set_id, n_articles, _own (edits of the article), _n (all of the user's
    edits), bucketed by user; an article in no set has null in place of it."""
    spark = history.sparkSession
    rows = history.where("user_id IS NOT NULL").select("user_id", "article_id")
    rows = fan_out(rows.join(members.select("article_id", "set_id", "n_articles"), "article_id", "left"), "user_id")
    edited = rows.groupBy("user_id", "article_id", "set_id", "n_articles").agg(F.count("*").alias("_own"))
    edited = edited.withColumn("_n", F.sum("_own").over(Window.partitionBy("user_id")))
    return bucketed(edited, "edited", bucket_count(spark), "user_id")


def _near_sets(members: DataFrame, similar: DataFrame) -> tuple[DataFrame, bool]:
    """set_a, set_b, similarity, and the size of the latter; without similarity, each set with itself.

    Also whether they are few enough to be sent to every executor.
    """
    pairs = similar.select("set_a", "set_b", "similarity")
    other = pairs.where("set_a <> set_b").select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "similarity")
    sizes = members.groupBy(F.col("set_id").alias("set_b")).agg(
        F.count_distinct("article_id").alias("_size"), (F.max("n_articles") > 1).alias("_copies")
    )
    itself = sizes.select(F.col("set_b").alias("set_a"), "set_b", F.lit(None).cast("double").alias("similarity"))
    near = stored(pairs.unionByName(other).unionByName(itself).join(sizes, "set_b"), "near-sets")
    return near, near.count() <= BROADCAST_SETS
