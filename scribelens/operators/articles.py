"""Article corpus: filters, markup to tokens, stems, quarantine of texts that do not parse."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.functions import text as T
from scribelens.functions.stopwords import ENGLISH
from scribelens.functions.stemming import stem_arrays, stem_terms

REDIRECT = "#REDIRECT"
DISAMBIGUATION = "{{disambiguation}}"


def content_articles(articles: DataFrame) -> DataFrame:
    """Main-namespace articles that are neither redirects nor disambiguation pages."""
    return articles.where(
        (F.col("ns") == 0)
        & ~F.col("text").startswith(REDIRECT)
        & ~F.col("text").endswith(DISAMBIGUATION)
    )


def _stripped(text: str):
    """Text without nested constructs and the reason if one is open, in an array of one.

    Generators over it evaluate the rules once per row, where a filter on a column would be
    pushed below it and evaluate them again."""
    return F.array(T.strip_constructs(T.apply_rules(F.lower(T.decompose(text)), T.WIKI_TAG_RULES)))


def wiki_tokens(articles: DataFrame, stem: bool = True) -> DataFrame:
    """Tokens of wiki markup; texts with open constructs are left to `quarantine`."""
    good = F.filter(_stripped("text"), lambda s: s["reason"].isNull())
    words = F.transform(good, lambda s: T.word_tokens(T.apply_rules(s["plain"], T.WIKI_TEXT_RULES)))
    tokens = articles.select("article_id", F.explode(words).alias("tokens"))
    return tokens.withColumn("tokens", stem_arrays("tokens")) if stem else tokens


def quarantine(articles: DataFrame) -> DataFrame:
    """Articles with a construct that is never closed, with the reason and their raw text."""
    reasons = F.filter(F.transform(_stripped("text"), lambda s: s["reason"]), lambda reason: reason.isNotNull())
    return articles.select("article_id", "title", "text", F.explode(reasons).alias("reason"))


def html_tokens(pages: DataFrame, stem: bool = True) -> DataFrame:
    """Tokens of HTML pages (page_id, html); case is kept."""
    body = T.apply_rules(F.col("html"), T.HTML_RULES)
    plain = T.apply_rules(T.decode_and_decompose(body), T.HTML_TEXT_RULES)
    tokens = pages.select("page_id", T.word_tokens(plain).alias("tokens"))
    return tokens.withColumn("tokens", stem_arrays("tokens")) if stem else tokens


def stem_vocabulary(tokens: DataFrame) -> DataFrame:
    """Distinct terms of a token table with their stems and how often they occur."""
    terms = tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")
    )
    return terms.select("term", stem_terms("term").alias("stem"), "n")


def tokenize(documents: DataFrame, text: str = "text") -> DataFrame:
    """Lower-case tokens between white space."""
    return documents.select("doc_id", T.whitespace_tokens(F.col(text)).alias("tokens"))


def stop_words(language: str = "english") -> list[str]:
    return ENGLISH if language == "english" else StopWordsRemover.loadDefaultStopWords(language)


def remove_stop_words(tokens: DataFrame, words: list[str] | None = None) -> DataFrame:
    remover = StopWordsRemover(inputCol="tokens", outputCol="_kept", stopWords=words or stop_words())
    return remover.transform(tokens).drop("tokens").withColumnRenamed("_kept", "tokens")
