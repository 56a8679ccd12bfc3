"""Vectors against brute force, URL rules, and the whole pipeline."""

import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from scribelens.llm import cover_tree, url_filter
from tests.compare import connect, difference
from tests.llm.conftest import rows_of
from tests.llm.test_dedup import by_union

FOLDER = "/root/testdata/sf0.001"


def brute(vectors, cosine=0.95):
    units = []
    for _, v in vectors:
        a = None if v is None or None in v or not v else np.array(v, np.float32).astype(float)
        units.append(None if a is None or not np.isfinite(a).all() or not a.any() else a / np.sqrt(a @ a))
    n = range(len(vectors))
    linked = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    links = [(i, j) for i in n for j in n if i < j and linked(i, j)]
    degree = [sum(k in e for e in links) for k in n]
    group = by_union(n, links)
    smallest = {}
    for k in n:
        i = vectors[k][0]
        if i is not None:
            smallest[group[k]] = min(i, smallest.get(group[k], i))
    return sorted(((vectors[k][0], degree[k], smallest.get(group[k]), vectors[k][0] == smallest.get(group[k])) for k in n), key=repr)


def made(seed, dims=8):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(120)]
    hot = rng.standard_normal(dims)
    rows += [hot + 0.08 * rng.standard_normal(dims) for _ in range(60)] + [hot] * 15 + [2 * hot]
    for _ in range(60):
        rows.append(rows[rng.integers(len(rows))] + 0.2 * rng.standard_normal(dims))
    return [[float(np.float32(x)) for x in r] for r in rows]


@pytest.mark.parametrize("block", [40, 4096])
def test_vector_links_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 0.0], [2.0, 0.01], [-0.0, 1.0], [0.0, 1.0]]
    vectors = list(enumerate(made(block) + odd)) + [(3, made(block)[3]), (None, made(block)[4]), (None, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 7, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<float>, run int, n int, first string")
    got = cover_tree.vector_groups(df.repartition(3))
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(vectors)


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_very_large_and_small_components_link(spark, scale):
    vectors = [(1, [scale, scale]), (2, [scale, 1.01 * scale]), (3, [1.0, 1.0]), (4, [-scale, scale])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = cover_tree.vector_groups(df)
    assert rows_of(got, "vec_id", "n_links", "component_id") == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_tree_of_several_levels_prunes_clusters(spark):
    """Clusters far apart, one of them half of all vectors: most pairs of blocks are dropped."""
    rng = np.random.default_rng(6)
    centres = 3 * rng.standard_normal((30, 16))
    which = np.where(rng.random(2000) < 0.4, 0, rng.integers(0, 30, 2000))
    rows = centres[which] + rng.standard_normal((2000, 16))
    prints = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, n bigint, embedding array<double>")
    blocks, steps = cover_tree.block_table(prints, 32)
    n = blocks.count()
    assert len(steps) >= 2 and n >= 2000 / 32 and blocks.where("size > 96").isEmpty()
    assert cover_tree.near_blocks(blocks, steps, 0.95).count() < 0.5 * n * (n + 1) / 2
    # Each of the pairs left out is apart indeed.
    units = cover_tree.unit(rows)
    dots = units @ units.T
    near = {(r.a, r.b) for r in cover_tree.near_blocks(blocks, steps, 0.95).collect()}
    home = {}
    for r in blocks.select("number", "tree").collect():
        home.update(dict.fromkeys(np.load(io.BytesIO(r.tree))["ids"].tolist(), r.number))
    for i, j in zip(*np.nonzero(dots >= 0.95)):
        assert (min(home[i], home[j]), max(home[i], home[j])) in near
    links = cover_tree.vector_links(prints, 0.95, 32).groupBy("u").agg(F.sum("links").alias("links"))
    want = {i: int(k) - 1 for i, k in enumerate((dots >= 0.95).sum(axis=1)) if k > 1}
    assert {r.u: r.links for r in links.collect()} == want


def test_no_vectors(spark):
    assert cover_tree.vector_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert rows_of(cover_tree.vector_groups(odd), "vec_id", "n_links", "kept") == [(1, 0, True), (2, 0, True)]


@pytest.mark.parametrize("few", [0.0, 1.0])
@pytest.mark.parametrize("dimensions", [2, 7, 64, 130])
def test_bounds_drop_only_pairs_without_links(monkeypatch, few, dimensions):
    """Independent directions are nearly all dropped by a few components; links are those of all pairs."""
    monkeypatch.setattr(cover_tree, "FEW", few)
    rng = np.random.default_rng(dimensions)
    rows = rng.normal(size=(300, dimensions))
    rows[200:260] = rows[:60] + 0.04 * rng.normal(size=(60, dimensions))
    rows[260:] = rows[0] + rng.uniform(0, 0.6, (40, 1)) * rng.normal(size=(40, dimensions))
    rows = cover_tree.unit(rows[rng.permutation(300)])
    x, y = rows[:150], rows[150:]
    limit = np.sqrt(0.1) + cover_tree.SLACK
    radii = rng.choice([0.0, 0.0, 0.1, 0.9], (2, 150))
    a, b, least = cover_tree._bounds(x, radii[0], y, radii[1], limit)
    possible = a @ b.T >= least
    near = np.sqrt(np.maximum(2 - 2 * x @ y.T, 0)) <= limit + radii[0][:, None] + radii[1]
    assert not (near & ~possible).any()
    if dimensions == 64:
        assert possible[radii[0] == 0][:, radii[1] == 0].mean() < 0.1 and a.shape[1] < dimensions / 3
    ones = np.ones(150, np.int64)
    links = cover_tree.traverse(x, cover_tree.build(x), ones, y, cover_tree.build(y), ones, 0.95, False)[:2]
    hit = x @ y.T >= 0.95
    assert (links[0] == hit.sum(axis=1)).all() and (links[1] == hit.sum(axis=0)).all()
    inside = cover_tree.traverse(x, cover_tree.build(x), ones, x, cover_tree.build(x), ones, 0.95, True)[0]
    assert (inside == (x @ x.T >= 0.95).sum(axis=1) - 1).all()


def test_tree_covers_every_row():
    x = cover_tree.unit(np.array(made(1)))
    tree = cover_tree.build(x)
    assert sorted(tree["order"].tolist()) == list(range(len(x)))
    for level, bound in enumerate((*cover_tree.RADII, 0.0)):
        begin = tree[f"p{level}"]
        for k, centre in enumerate(tree[f"c{level}"]):
            rows = tree["order"][begin[k] : begin[k + 1]]
            far = np.sqrt(np.maximum(2 - 2 * x[rows] @ x[centre], 0)).max() if len(rows) > 1 else 0
            assert centre in rows and far <= tree[f"r{level}"][k] + 1e-9 and tree[f"r{level}"][k] <= bound + 1e-9


URLS = [
    None, "", "no scheme here", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?y#z", "http://example.net/EN/",
    "http://xnet/", "http://a.net?x=/", "http://a.net#/", "ftp://b.example.com/de/1", "http://example.com/de", "http://example.com/fr/de/",
    "http://q.org/fr/", "http://q.org/fr", "http://org/fr/://net/", "x://y://z.net/", "http://É.NET/a b\n/c", "http://a..net//", "http://net:80/",
]


def brute_verdict(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *(best or (None, "allow")))


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string, host string, token string")
    want = sorted([(i, *brute_verdict(u)) for i, u in enumerate(URLS + URLS[:3])], key=repr)
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert rows_of(url_filter.judge(pages), *columns) == want
    table = spark.createDataFrame([tuple(r) for r in url_filter.RULES], "rule string, verdict string, pattern string, tokens array<string>")
    assert rows_of(url_filter.judge_by_table(pages, table), *columns) == want
    assert url_filter.judge(pages.limit(0)).isEmpty()
    assert {r.verdict for r in url_filter.judge(pages, rules=[], default="block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = url_filter.with_parts(spark.createDataFrame([(f"http://a.net/en/{i}",) for i in range(5)] + [("http://example.net/",)], "url string"))
    filed = url_filter.rarest_tokens(pages, url_filter.RULES)
    assert filed["net/"] == ".net" and filed["example.net/en/"] == ".example" and filed["org/fr/"] == ".org"


def test_a_rule_without_tokens_meets_every_url(spark):
    rule = url_filter.Rule("digits", "block", r"\d{3}", ())
    pages = spark.createDataFrame([("http://a.b/123",), ("http://a.b/12",), (None,)], "url string")
    assert [r.verdict for r in url_filter.judge(pages, [rule, *url_filter.RULES]).collect()] == ["block", "allow", "allow"]


def test_url_query_against_sql(spark):
    assert difference(url_filter.op2_url_filter(spark, FOLDER), connect(FOLDER), url_filter.ORACLE) is None


def test_pipeline_by_its_stages(spark):
    """Every stage keeps the columns of documents and works on what the one before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = rows_of(corpus_pipeline.run(spark, FOLDER), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER).cache()
        assert kept.columns == docs.columns and kept.join(docs, "doc_id", "left_anti").isEmpty()
        counts.append(kept.count())
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert rows_of(last, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == whole
    assert last.select("doc_id").distinct().count() == counts[-1] == len({r[0] for r in whole})
    assert counts[0] < spark.read.parquet(f"{FOLDER}/documents.parquet").count() and counts == sorted(counts, reverse=True)


def test_stages_take_empty_and_messy_tables(spark, docs, empty):
    messy = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (messy, empty):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER)
        now.collect()


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
