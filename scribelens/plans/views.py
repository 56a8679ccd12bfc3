"""The engine's inputs, derived from the benchmark tables.

Each function takes (spark, folder) and reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.layout import spread, stored
from scribelens.operators import edits as E
from scribelens.operators import topics as T
from scribelens.session import shared_path
from scribelens.sinks.tables import write_split

SPLIT_DAY = "21.01.2024"
ORDERS_SPLIT_DAY = "01.01.2000"
TOPICS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Edit history from the event log -----------------------------------------------------------


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("article_id"),
        "user_id",
        F.floor("value").cast("bigint").alias("bytes"),
        (F.col("event_type") == "view").alias("minor"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("ns"),
    )


def user_groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_acctbal") < 0, "bot").otherwise("user").alias("user_group"),
    )


def group_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ``user,group``; every third user is in a second group."""
    groups = user_groups(spark, folder)
    more = groups.where("user_id % 3 = 0").withColumn("user_group", F.lit("editor"))
    return groups.unionByName(more).select(F.concat_ws(",", F.col("user_id").cast("string"), "user_group").alias("value"))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return E.clean_revisions(revisions(spark, folder), user_groups(spark, folder))


def training_test(
    spark: SparkSession, folder: str, day: str = SPLIT_DAY
) -> tuple[DataFrame, DataFrame]:
    """Aggregated training and test edits, stored as the edit job leaves them."""
    return _stored_split(E.with_split(clean(spark, folder), day))


def _stored_split(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = edits.sparkSession
    path = shared_path(spark, "edits")
    write_split(E.aggregate_edits(edits, "split"), path)
    tables = spark.read.parquet(path)
    return tuple(tables.where(F.col("split") == s).drop("split") for s in ("training", "test"))


def revision_lines(spark: SparkSession, folder: str) -> DataFrame:
    size = F.when(F.col("bytes") == 0, F.lit("null")).otherwise(F.col("bytes").cast("string"))
    return revisions(spark, folder).select(
        F.concat_ws(
            ",",
            F.col("article_id").cast("string"),
            F.col("user_id").cast("string"),
            size,
            F.col("minor").cast("string"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ).alias("value")
    )


def truth_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ``user,article``; those of error events carry a third field."""
    return table(spark, folder, "events").select(
        F.concat(
            F.col("user_id").cast("string"),
            F.lit(","),
            F.regexp_extract("props", "([0-9]+)", 1),
            F.when(F.col("event_type") == "error", F.lit(",0")).otherwise(F.lit("")),
        ).alias("value")
    )


def edit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ``user,article,bytes,n``; those of three kinds of events are damaged."""
    user, article = F.col("user_id").cast("string"), F.regexp_extract("props", "([0-9]+)", 1)
    whole = F.concat_ws(",", user, article, F.lit("7"), F.lit("1"))
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.when(kind == "error", F.concat(F.lit("abc"), whole))
        .when(kind == "signup", F.concat(whole, F.lit(",9")))
        .when(kind == "purchase", user)
        .otherwise(whole)
        .alias("value")
    )


# Edit history from the order book ----------------------------------------------------------


def order_revisions(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("article_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_quantity").cast("bigint").alias("bytes"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
    )


def order_training_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _stored_split(E.with_split(order_revisions(spark, folder), ORDERS_SPLIT_DAY))


# Articles ----------------------------------------------------------------------------------


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents wrapped in wiki markup; their labels make some of them redirects,
    disambiguation pages or broken markup."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text", "lang", "source")
    labels = table(spark, folder, "labels")
    title = F.concat(F.col("source"), F.lit(" page "), F.col("doc_id").cast("string"))
    lead = F.when(
        F.col("quality") == 0, F.concat(F.lit("#REDIRECT [["), F.col("source"), F.lit("]]\n"))
    ).otherwise(F.lit(""))
    tail = F.when(F.col("toxic") == 1, "{{disambiguation}}").when(
        F.col("source") == "src17", "{{cite [[open"
    ).otherwise("")
    wrapped = F.concat(
        lead,
        F.lit("{{Infobox page|source="), F.col("source"), F.lit("|lang={{lang|"), F.col("lang"),
        F.lit("}}}}\n'''"), title, F.lit("''' <!-- draft --><ref name=\"a\">Source & notes</ref>\n"),
        F.col("text"),
        F.lit(
            "\n{| class=\"wikitable\"\n| cell {{deep|{{deeper|{{still|{{more|{{five|}}}}}}}}}} {| inner\n| table\n|}\n|}\n"
            "{{cite|title={hidden}}} {{Infobox|data={|\n|hidden\n|} }}[[File:a.png|thumb|see [[hidden caption]] there]]"
        ),
        F.lit("\n[http://example.org/page outside link] [[Main page|front page]]"),
        F.lit(" [[Category:"), F.col("lang"), F.lit("]]<br/>"),
        tail,
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("source").isin("src18", "src19"), 1).otherwise(0).alias("ns"),
        title.alias("title"),
        wrapped.alias("text"),
    )


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of an article dump."""
    text = F.struct(F.lit("preserve").alias("_space"), F.col("text").alias("_VALUE"))
    return articles(spark, folder).select(
        "title",
        "ns",
        F.col("article_id").alias("id"),
        F.struct(F.lit(1).alias("id"), text.alias("text")).alias("revision"),
    )


def history_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of a revision dump; a page holds an article's revisions of one day."""
    registered = F.col("user_id") > 0
    contributor = F.struct(
        F.when(registered, "name").alias("username"),
        F.when(registered, F.col("user_id")).alias("id"),
        F.when(~registered, "::1").alias("ip"),
    )
    revision = F.struct(
        F.lit(1).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        contributor.alias("contributor"),
        F.when(F.col("minor"), "").alias("minor"),
        F.struct(F.col("bytes").alias("_bytes"), F.lit("").alias("_VALUE")).alias("text"),
    )
    return (
        revisions(spark, folder)
        .groupBy("article_id", "ns", F.to_date("ts").alias("day"))
        .agg(F.collect_list(revision).alias("revision"))
        .select(F.lit("title").alias("title"), "ns", F.col("article_id").alias("id"), "revision")
    )


# Vectors -----------------------------------------------------------------------------------


def distributions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("weights"),
    )


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Stored topic assignments, as a trained model leaves them."""
    return stored(T.top_topics(distributions(spark, folder)), "assignments")


def factor_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every embedding as a user and as an item."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features")
    )
    return (
        vectors.withColumnRenamed("vec_id", "user_id"),
        vectors.withColumnRenamed("vec_id", "article_id"),
    )


# Categories --------------------------------------------------------------------------------


# Suppliers are the nodes 1, 2, …: node 0, the root above them, is the parent of the first.


def _node(key: str) -> Column:
    return F.col(key).cast("bigint") + 1


def tree_lines(spark: SparkSession, folder: str) -> DataFrame:
    edge = F.array(F.col("src").cast("string"), F.col("dst").cast("string"))
    return tree(spark, folder).select(F.array_join(edge, ",").alias("value"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    node = table(spark, folder, "supplier").select(_node("s_suppkey").alias("src"))
    return node.select("src", F.expr("src div 2").alias("dst"))


def cyclic_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The tree plus an edge from each supplier to the node of its nation."""
    extra = table(spark, folder, "supplier").select(_node("s_suppkey").alias("src"), _node("s_nationkey").alias("dst"))
    return tree(spark, folder).union(extra)


def links(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select(_node("l_suppkey").alias("category_id"), F.col("l_partkey").alias("article_id"))
        .distinct()
    )


def _category_id(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")


def _part_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Name of each category of a part with the name of the category above it."""
    size, brand = F.col("p_size"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    word = F.split("p_name", " ")
    pairs = [
        (F.concat(F.lit("size "), size), F.concat(F.lit("sizes "), F.floor(size / 10))),
        (F.concat(F.lit("brand "), brand), F.concat(F.lit("brands "), F.floor(brand / 5))),
        (F.concat(F.lit("look "), word[0]), F.lit("looks")),
        (F.concat(F.lit("thing "), word[1]), F.lit("things")),
        (F.concat(F.lit("type "), F.col("p_type")), F.lit("types")),
    ]
    rows = F.array(*[F.struct(c.alias("name"), p.alias("above")) for c, p in pairs])
    return table(spark, folder, "part").select("p_partkey", F.explode(rows).alias("c"))


def part_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of parts below groups, and groups below one root per attribute."""
    named = _part_categories(spark, folder)
    lower = named.select(F.col("c.name").alias("a"), F.col("c.above").alias("b"))
    upper = named.where("c.above LIKE '% %'").select(
        F.col("c.above").alias("a"), F.split("c.above", " ")[0].alias("b")
    )
    both = lower.union(upper).distinct()
    return both.select(_category_id(F.col("a")).alias("src"), _category_id(F.col("b")).alias("dst"))


def part_links(spark: SparkSession, folder: str) -> DataFrame:
    return _part_categories(spark, folder).select(
        _category_id(F.col("c.name")).alias("category_id"), F.col("p_partkey").alias("article_id")
    )


def category_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Dump lines of the category table, with escaped quotes and parentheses in the names."""
    return table(spark, folder, "supplier").select(
        F.concat(
            F.lit("INSERT INTO `category` VALUES ("), F.col("s_suppkey").cast("string"),
            F.lit(",'O\\'"), F.col("s_name"), F.lit(" (cat)',"), F.col("s_nationkey").cast("string"), F.lit(",0,0);"),
        ).alias("value")
    )


def link_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Dump lines of the link table, two tuples each; some targets do not exist."""
    name = F.concat(
        F.lit("'O\\'Supplier#"),
        F.lpad((F.col("l_suppkey") + F.col("l_linenumber") - 1).cast("string"), 9, "0"),
        F.lit(" (cat)'"),
    )
    kind = F.when(F.col("l_returnflag") == "A", "page").when(
        F.col("l_returnflag") == "N", "subcat"
    ).otherwise("file")
    rest = F.concat(F.lit(",'KEY\\n,(x)','2012-01-01 00:00:00','','uca','"), kind, F.lit("')"))
    return spread(table(spark, folder, "lineitem")).select(
        F.concat(
            F.lit("INSERT INTO `categorylinks` VALUES ("), F.col("l_partkey").cast("string"), F.lit(","), name,
            rest, F.lit(",("), F.col("l_orderkey").cast("string"), F.lit(","), name, rest, F.lit(";"),
        ).alias("value")
    )
