import pytest

LONG = "Lorem ipsum, dolor sit amet. " * 4000
SAME = "One line that is shared.\nAnother line that is shared.\nshort"
TEXTS = [
    (1, "The quick brown fox\njumps over the lazy dog"),
    (2, "The quick  brown fox jumps over the lazy dog "),  # equal but for white space, longer
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, LONG),
    (7, LONG + "x"),
    (8, SAME),
    (9, SAME + "\nown line of number nine"),
    (9, SAME + "\nown line of number nine"),  # repeated row
    (10, "ANOTHER LINE THAT IS SHARED.  \n\x0bone line that is shared.\x0c"),
    (11, "é中🙂 \x85 <|endoftext|> </s> ▁ tail\n\n"),
    (12, "solo"),
    (13, "two words"),
    (None, "The quick brown fox jumps over the lazy dog"),
    (None, "nobody's text, found once"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [(i, t, None, "hot", None if t is None else len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def cluttered(docs):
    """The same rows with further columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = "row_id run digest check n key fp ids place part size shard slot first gone best n_plain score kept".split()
    return docs.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    """Sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
