import random
from collections import Counter

import pytest

from scribelens.functions.stemming import porter2
from scribelens.operators import articles as A
from scribelens.operators import corpus as K
from scribelens.sources import sql_dump, vectors
from scribelens.plans.jobs import write_truth_vectors
from scribelens.sinks.tables import vector_lines, vocabulary_line, write_single_file


def article(spark, text, ns=0):
    return spark.createDataFrame([(1, ns, "T", text)], "article_id BIGINT, ns INT, title STRING, text STRING")


def wiki(spark, text, stem=False):
    return A.wiki_tokens(article(spark, text), stem).first().tokens


def page(spark, html, stem=False):
    df = spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")
    return A.html_tokens(df, stem).first().tokens


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("The quick [[Brown fox|foxes]] jumped", ["quick", "foxes", "jumped"]),
        ("{{Infobox|{{nested|value}}|more}} words here", ["words", "here"]),
        ("before {| class=x\n| hidden\n|} after", ["before", "after"]),
        ("seen<ref name=\"a\">hidden</ref> text<ref name=b/> ends", ["seen", "text", "ends"]),
        ("<!-- hidden --> shown [[Category:Hidden]] [[File:Hidden.png|thumb]]", ["shown"]),
        ("'''bold''' ''ital''ics [http://a.b/c outer link]", ["bold", "italics", "outer", "link"]),
        ("café naïveté", ["cafe", "vete"]),  # an accent separates what follows it
        ("two three four", ["three", "four"]),
    ],
)
def test_wiki_markup(spark, text, tokens):
    assert wiki(spark, text) == tokens


def test_stems_follow_tokens(spark):
    assert wiki(spark, "Running foxes generally jumped", stem=True) == ["run", "fox", "general", "jump"]
    assert wiki(spark, "a b c", stem=True) == []


def test_quarantine_takes_what_tokens_leave(spark):
    broken = article(spark, "open {{template")
    assert A.wiki_tokens(broken).isEmpty()
    kept = A.quarantine(broken).first()
    assert kept.reason == "template" and kept.text == "open {{template"
    assert A.quarantine(article(spark, "fine {{x}}")).isEmpty()
    assert A.quarantine(article(spark, "open {| table {{x}}")).first().reason == "table"
    assert A.quarantine(article(spark, "open [[link")).first().reason == "link"
    assert A.quarantine(article(spark, None)).first().reason == "no text"


def test_html(spark):
    html = (
        "<html><head><title>hidden</title></head><body><style>p{hidden:1}</style><script>hidden()</script>"
        "<p>Shown<b>Bold</b> text</p><p>next</p><ref>hidden</ref>{{hidden}} [[Category:Things]] caf&eacute;s &amp; more"
        "</body></html>"
    )
    assert page(spark, html) == ["ShownBold", "text", "next", "Things", "cafe", "more"]


@pytest.mark.parametrize(
    "text,ns,kept",
    [
        ("plain", 0, True),
        ("plain", 1, False),
        ("#REDIRECT [[x]]", 0, False),
        ("#redirect [[x]]", 0, True),
        (" #REDIRECT [[x]]", 0, True),
        ("x {{disambiguation}}", 0, False),
        ("x {{disambiguation}} ", 0, True),
        ("x {{Disambiguation}}", 0, True),
    ],
)
def test_article_filter_is_exact(spark, text, ns, kept):
    assert A.content_articles(article(spark, text, ns)).count() == int(kept)


# Pairs from the published description of the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "consolidate": "consolid",
    "consolingly": "consol", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirators": "conspir", "constables": "constabl", "constancy": "constanc",
    "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead",
    "kneeling": "kneel", "knightly": "knight", "knitted": "knit", "knives": "knive",
    "knotted": "knot", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
    "hoping": "hope", "hopping": "hop", "hoped": "hope", "luxuriated": "luxuri", "say": "say",
    "cry": "cri", "by": "by", "generate": "generat", "generic": "generic", "communism": "communism",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "succeed": "succeed",
    "relational": "relat", "sensibility": "sensibl", "happiness": "happi", "activate": "activ",
    "replacement": "replac", "adoption": "adopt", "rate": "rate", "controlling": "control",
    "youth": "youth", "boyish": "boyish", "geology": "geolog", "hopefulness": "hope",
}


@pytest.mark.parametrize("word,stem", STEMS.items())
def test_porter2(word, stem):
    assert porter2(word) == stem


def test_stop_words_go_after_stemming(spark):
    docs = spark.createDataFrame([(1, "This  that\tHAVING words\nhave")], "doc_id BIGINT, text STRING")
    tokens = A.tokenize(docs)
    assert tokens.first().tokens == ["this", "that", "having", "words", "have"]
    assert A.remove_stop_words(tokens).first().tokens == ["words"]
    assert A.remove_stop_words(tokens, ["words"]).first().tokens == ["this", "that", "having", "have"]


def test_counts_and_fitted_vectors_agree(spark):
    docs = spark.createDataFrame(
        [(1, "apple pear apple"), (2, "pear plum pear"), (3, "")], "doc_id BIGINT, text STRING"
    )
    tokens = A.remove_stop_words(A.tokenize(docs))
    vocab = K.vocabulary(tokens, 2)
    assert [(r.idx, r.term, r.n) for r in vocab.orderBy("idx").collect()] == [(0, "pear", 3), (1, "apple", 2)]
    counts = {(r.doc_id, r.idx): r["count"] for r in K.term_counts(tokens, vocab).collect()}
    assert counts == {(1, 0): 1, (1, 1): 2, (2, 0): 2}
    model = K.fit_text(docs, 2)
    fitted = {r.doc_id: r.features for r in K.vectorize(model, docs).collect()}
    assert {(d, i): v for d, f in fitted.items() for i, v in zip(f.indices.tolist(), f.values)} == counts
    terms = {r.idx: r.term for r in K.fitted_vocabulary(model, docs).collect()}
    assert terms == {0: "pear", 1: "apple"}


def test_vector_lines_round_trip(spark, lines):
    parsed = vectors.parse_vectors(lines("7;title;(10,[1,4],[2.0,0.5])", "8;(10,[],[])", "9;x;[0.0,1.5,0.0,2.0]"))
    first, second, dense = parsed.orderBy("doc_id").collect()
    assert (first.doc_id, first.size, first.indices, first.counts) == (7, 10, [1, 4], [2.0, 0.5])
    assert second.indices == []
    assert (dense.doc_id, dense.size, dense.indices, dense.counts) == (9, 4, [1, 3], [1.5, 2.0])
    again = vectors.parse_vectors(vector_lines(parsed)).orderBy("doc_id").collect()
    assert again == [first, second, dense]
    assert [tuple(r) for r in vectors.parse_vocabulary(lines("b,a,c")).collect()] == [(0, "b"), (1, "a"), (2, "c")]


# SQL dumps


def tuples(lines, text):
    return [r.fields for r in sql_dump.parse_tuples(lines(text)).collect()]


def test_dump_lines(lines):
    assert tuples(lines, "INSERT INTO (1,2,3),(a,b,c)\n") == [["1", "2", "3"], ["a", "b", "c"]]
    escaped = "INSERT INTO ('\n(\\'a\\')\n',b,c),(d,e,f)\n"
    assert tuples(lines, escaped) == [["\n('a')\n", "b", "c"], ["d", "e", "f"]]


def test_dump_details(lines):
    assert tuples(lines, "CREATE TABLE x (a,b)") == []
    assert tuples(lines, "INSERT INTO `t` (`a`, `b`) VALUES (1,'x,y'),(2,'')") == [["1", "x,y"], ["2", ""]]
    assert tuples(lines, "INSERT INTO t VALUES ('a\\\\','b\\n')") == [["a\\", "bn"]]
    long = "x" * 200_000
    assert tuples(lines, f"INSERT INTO t VALUES ('{long}',1)") == [[long, "1"]]


def test_dump_encoding(spark, tmp_path):
    (tmp_path / "d.sql").write_bytes("INSERT INTO t VALUES (1,'Café')\n".encode("latin-1"))
    got = sql_dump.categories(sql_dump.read_lines(spark, str(tmp_path / "d.sql"), "ISO-8859-1"))
    assert got.first().name == "Café"


@pytest.mark.parametrize("capacity", [3, 40, 400, None])
def test_vocabulary_from_summaries(spark, capacity):
    """Summaries too small to prove anything, small ones that need a second scan, and large ones."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs = [(d, rng.choices(words, [1 / (i + 1) ** 1.5 for i in range(300)], k=60)) for d in range(80)]
    tokens = spark.createDataFrame(docs, "doc_id BIGINT, tokens ARRAY<STRING>").repartition(4)
    counts = Counter(w for _, ws in docs for w in ws)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    got = K.vocabulary(tokens, 10, capacity).orderBy("idx").collect()
    assert [(r.term, r.n) for r in got] == want and [r.idx for r in got] == list(range(10))


def test_tasks_hold_a_bounded_number_of_terms(spark):
    """By default a task sends at most 40 terms for each of the vocabulary, and the counts stay exact."""
    docs = [(d, ["hot", "warm"] * 20 + [f"w{d}x{i}" for i in range(40)]) for d in range(60)]
    tokens = spark.createDataFrame(docs, "doc_id BIGINT, tokens ARRAY<STRING>").coalesce(1)
    assert K._summaries(tokens, K.TRACKED * 2).count() <= 2 * 20 * 2 + 1
    assert [(r.term, r.n) for r in K.vocabulary(tokens, 2).orderBy("idx").collect()] == [("hot", 1200), ("warm", 1200)]


def test_vocabulary_of_nothing(spark):
    tokens = spark.createDataFrame([(1, [])], "doc_id BIGINT, tokens ARRAY<STRING>")
    assert K.vocabulary(tokens).isEmpty() and K.vocabulary(tokens.limit(0)).isEmpty()


def test_fitted_vectors_use_the_ordered_vocabulary(spark):
    docs = spark.createDataFrame([(1, "pear plum fig the"), (2, "fig plum"), (3, "pear apple")], "doc_id BIGINT, text STRING")
    model = K.fit_text(docs, 2)
    assert [r.term for r in K.fitted_vocabulary(model, docs).orderBy("idx").collect()] == ["fig", "pear"]
    assert {r.doc_id: r.features.toArray().tolist() for r in K.vectorize(model, docs).collect()} == {1: [1, 1], 2: [1, 0], 3: [0, 1]}


def test_stored_vectors_are_joined_without_an_exchange(spark, pairs, tmp_path):
    rows = [(d, 10, [d % 10], [float(d)]) for d in range(200)]
    store = K.vector_store(spark.createDataFrame(rows, "doc_id BIGINT, size INT, indices ARRAY<INT>, counts ARRAY<DOUBLE>"))
    truth = pairs(*[(u, 3 * u) for u in range(90)], (1, 3), (7, 10_000))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = K.documents_in_truth(store, truth)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 67
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # The plan is printed from the top, the vectors before the truth.
    assert "Exchange" not in plan[: plan.index("Bucketed: true")] and "Exchange" in plan
    write_truth_vectors(store, truth, str(tmp_path / "lines"))
    again = vectors.vector_entries(vectors.read_vectors(spark, str(tmp_path / "lines")))
    assert sorted(tuple(r) for r in again.collect()) == [(d, d % 10, float(d)) for d in range(0, 200, 3)]


def test_vocabulary_line_is_one_file(spark, tmp_path):
    tokens = spark.createDataFrame([(1, ["b", "a", "b"])], "doc_id BIGINT, tokens ARRAY<STRING>")
    write_single_file(vocabulary_line(K.vocabulary(tokens)), str(tmp_path / "v"))
    assert len(list((tmp_path / "v").glob("part-*"))) == 1
    assert [tuple(r) for r in vectors.read_vocabulary(spark, str(tmp_path / "v")).collect()] == [(0, "b"), (1, "a")]
