"""DuckDB SQL that computes the registered queries independently of Spark.

Queries are assembled from named common table expressions; `_with` pulls in what a query
needs. The SQL follows the definitions, not the Spark plans: plain joins, windows and brute
force.
"""

from __future__ import annotations

import re

from scribelens.functions import text as T
from scribelens.functions.stopwords import ENGLISH
from scribelens.operators.corpus import VOCABULARY_SIZE
from scribelens.plans import registry as R
from scribelens.plans import views as D


def _day(text: str) -> str:
    d, m, y = text.split(".")
    return f"TIMESTAMP '{y}-{m}-{d} 00:00:00'"


def _regex_chain(column: str, rules) -> str:
    for pattern, replacement in rules:
        pat = pattern.replace("'", "''")
        rep = re.sub(r"\$(\d)", r"\\\1", replacement)
        column = f"regexp_replace({column}, '{pat}', '{rep}', 'g')"
    return column


def _decomposed(column: str) -> str:
    """Base letters followed by a blank for each accent: what NFD leaves of a word."""
    return f"strip_accents(regexp_replace({column}, '([^\\x00-\\x7F])', '\\1 ', 'g'))"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '[^a-zA-Z0-9_]+'), lambda x: length(x) > 3)"


def _stop_words() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


def _tree(source: str, name: str) -> str:
    return f"""{name}(src, dst) AS (
        SELECT src, dst FROM {source}
        UNION SELECT c.src, e.dst FROM {name} c JOIN {source} e ON c.dst = e.src)"""


def _topic_ctes(prefix: str, history: str, n: int) -> list[tuple[str, str]]:
    """Profile and scores of one pass over a history table (u, a)."""
    return [
        (f"{prefix}_profile", f"SELECT u, topic, sum(weight) AS p FROM {history} JOIN assignments ON a = doc_id GROUP BY ALL"),
        (f"{prefix}_total", f"SELECT u, sum(p) AS t FROM {prefix}_profile GROUP BY u"),
        (
            f"{prefix}_scores",
            f"""SELECT p.u, c.doc_id AS a, round(sum(p.p * c.weight / t.t), 9) AS score
            FROM {prefix}_profile p JOIN {prefix}_total t ON p.u = t.u
            JOIN (SELECT * FROM docs_of_topic WHERE r <= {3 * n}) c ON c.topic = p.topic GROUP BY ALL""",
        ),
    ]


def _topic_lists(name: str, n: int, prf: int = 20, exclude: bool = True) -> list[tuple[str, str]]:
    keep = "WHERE (u, a) NOT IN (SELECT (u, a) FROM known)" if exclude else ""
    return [
        ("sizes", "SELECT u, count(*) AS k FROM known GROUP BY u"),
        *_topic_ctes(f"{name}_one", "known", n),
        (
            f"{name}_feedback",
            f"""SELECT u, a FROM (SELECT s.u, a, k, row_number() OVER (PARTITION BY s.u ORDER BY score DESC, a) AS r
            FROM {name}_one_scores s JOIN sizes z ON s.u = z.u WHERE k < {prf}) WHERE r <= {prf} - k""",
        ),
        (f"{name}_history", f"SELECT u, a FROM known UNION SELECT u, a FROM {name}_feedback"),
        *_topic_ctes(f"{name}_two", f"{name}_history", n),
        (
            name,
            f"""SELECT * FROM (SELECT u, a, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, a) AS r
            FROM {name}_two_scores {keep}) WHERE r <= {n}""",
        ),
    ]


def _factor_lists(name: str, n: int) -> tuple[str, str]:
    return (
        name,
        f"""SELECT u, a, score, r FROM (
            SELECT u, a, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, a) AS r FROM (
                SELECT x.vec_id AS u, y.vec_id AS a,
                       round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS score
                FROM embeddings x, embeddings y)) WHERE r <= {n} AND score >= 0""",
    )


def _blend_lists(name: str, factor: str, topic: str, n: int) -> list[tuple[str, str]]:
    return [
        (
            f"{name}_in",
            f"""SELECT 'factor' AS s, 1.0 AS w, u, a, score FROM {factor} WHERE r <= {3 * n}
            UNION ALL SELECT 'topic', 2.0, u, a, score FROM {topic} WHERE r <= {3 * n}""",
        ),
        (f"{name}_range", f"SELECT s, w, u, min(score) AS lo, max(score) AS hi FROM {name}_in GROUP BY ALL HAVING max(score) > 0"),
        (f"{name}_pairs", f"SELECT DISTINCT i.u, i.a FROM {name}_in i JOIN {name}_range r ON i.u = r.u AND i.s = r.s"),
        (
            name,
            f"""SELECT u, a, score, r FROM (
            SELECT u, a, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, a) AS r FROM (
                SELECT p.u, p.a, round(sum(g.w * coalesce(i.score, 0.99 * g.lo) / g.hi), 9) AS score
                FROM {name}_pairs p JOIN {name}_range g ON p.u = g.u
                LEFT JOIN {name}_in i ON i.u = p.u AND i.a = p.a AND i.s = g.s GROUP BY ALL)) WHERE r <= {n}""",
        ),
    ]


def _metric_ctes(name: str, lists: str) -> list[tuple[str, str]]:
    """Per-user metrics of the lists (u, a, r) for the sampled users."""
    return [
        (
            f"{name}_hits",
            f"""SELECT l.u, l.r, row_number() OVER (PARTITION BY l.u ORDER BY l.r) AS c
            FROM {lists} l JOIN truth t ON l.u = t.u AND l.a = t.a""",
        ),
        (
            name,
            f"""SELECT s.user_id AS u, s.position,
                coalesce(n.k, 0) AS n_recommended, g.k AS n_truth, coalesce(h.k, 0) AS n_hits,
                CASE WHEN coalesce(n.k, 0) = 0 THEN 0.0 ELSE coalesce(h.k, 0) / n.k END AS precision,
                coalesce(h.ap, 0.0) AS average_precision, coalesce(h.k, 0) / g.k AS recall,
                coalesce(h.k100, 0) / g.k AS recall_at_100, coalesce(h.k500, 0) / g.k AS recall_at_500,
                coalesce(h.k1000, 0) / g.k AS recall_at_1000,
                CASE WHEN coalesce(h.k, 0) = 0 THEN 0.0
                     ELSE 2 * (h.k / n.k) * (h.k / g.k) / (h.k / n.k + h.k / g.k) END AS f_measure
            FROM sample s JOIN (SELECT u, count(*) AS k FROM truth GROUP BY u) g ON s.user_id = g.u
            LEFT JOIN (SELECT u, count(*) AS k FROM {lists} GROUP BY u) n ON n.u = s.user_id
            LEFT JOIN (SELECT u, count(*) AS k, avg(c / r) AS ap, count(*) FILTER (r <= 100) AS k100,
                       count(*) FILTER (r <= 500) AS k500, count(*) FILTER (r <= 1000) AS k1000
                       FROM {name}_hits GROUP BY u) h ON h.u = s.user_id""",
        ),
    ]


_SHARES = ("precision", "average_precision", "recall", "f_measure")
_RECALLS = ("recall_at_100", "recall_at_500", "recall_at_1000")


def _summary_select(metrics: str) -> str:
    parts = ["count(*) AS processed"]
    parts += [f"round(avg({m}), 6) AS avg_{m}" for m in _SHARES + _RECALLS]
    parts += [
        f"round(list_sort(list({m}))[count(*) // 2 + 1], 6) AS median_{m}" for m in _SHARES
    ]
    return f"SELECT {', '.join(parts)} FROM {metrics}"


def _running_select(metrics: str) -> str:
    """Brute force: the summary of the first i users for every i."""
    parts = ["count(*) AS processed", "x.u AS user_id"]
    parts += [f"round(avg(y.{m}), 6) AS avg_{m}" for m in _SHARES + _RECALLS]
    parts += [
        f"round(list_sort(list(y.{m}))[count(*) // 2 + 1], 6) AS median_{m}" for m in _SHARES
    ]
    return f"""SELECT {', '.join(parts)} FROM {metrics} x JOIN {metrics} y ON y.position <= x.position
        GROUP BY x.u, x.position"""


_STRING = r"'[^'\\]*(?:\\.[^'\\]*)*'"
_TUPLE = rf"(?s)\([^)']*(?:{_STRING}[^)']*)*\)"
_FIELD = rf"(?s),([^,']*(?:{_STRING}[^,']*)*)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fields(lines: str) -> str:
    """Decoded fields of the tuples of dump lines."""
    unquote = _q(r"(?s)'([^'\\]*(?:\\.[^'\\]*)*)'")
    unescape = _q(r"(?s)\\(.)")
    return f"""SELECT list_transform(
        regexp_extract_all(',' || substr(t, 2, length(t) - 2), {_q(_FIELD)}, 1),
        lambda f: CASE WHEN contains(f, '''') THEN
            regexp_replace(regexp_replace(f, {unquote}, '\\1', 'g'), {unescape}, '\\1', 'g') ELSE f END) AS f
        FROM (SELECT unnest(regexp_extract_all(value, {_q(_TUPLE)})) AS t FROM {lines})"""


def _link_line() -> str:
    kind = "CASE l_returnflag WHEN 'A' THEN 'page' WHEN 'N' THEN 'subcat' ELSE 'file' END"
    name = "'''O\\''Supplier#' || lpad(CAST(l_suppkey + l_linenumber - 1 AS VARCHAR), 9, '0') || ' (cat)'''"
    rest = f"',''KEY\\n,(x)'',''2012-01-01 00:00:00'','''',''uca'',''' || {kind} || ''')'"
    return (
        "SELECT 'INSERT INTO `categorylinks` VALUES (' || l_partkey || ',' || "
        f"{name} || {rest} || ',(' || l_orderkey || ',' || {name} || {rest} || ';' AS value FROM lineitem"
    )


_CTES: dict[str, str] = {
    "revisions": """SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS a, user_id AS u,
        CAST(floor(value) AS BIGINT) AS bytes, event_type = 'view' AS minor, ts,
        CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS ns FROM events""",
    "clean": """SELECT a, u, bytes, ts FROM revisions WHERE ts IS NOT NULL AND u <> 0 AND ns = 0 AND NOT minor
        AND u NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "split": f"SELECT *, CASE WHEN ts >= {_day(D.SPLIT_DAY)} THEN 'test' ELSE 'training' END AS part FROM clean",
    "known": "SELECT DISTINCT u, a FROM split WHERE part = 'training'",
    "truth": """SELECT DISTINCT u, a FROM split WHERE part = 'test' AND (u, a) NOT IN (SELECT (u, a) FROM known)
        AND a IN (SELECT a FROM known) AND u IN (SELECT u FROM known)""",
    "sample": f"""SELECT user_id, row_number() OVER (ORDER BY k, user_id) AS position FROM (
        SELECT DISTINCT u AS user_id, md5(concat(u, ':{R.SEED}')) AS k FROM truth ORDER BY k, user_id LIMIT {R.SAMPLE})""",
    "purchases": """SELECT l_partkey AS a, o_custkey AS u, CAST(l_quantity AS BIGINT) AS bytes, l_shipdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "bought": f"SELECT DISTINCT u, a FROM purchases WHERE ts < {_day(D.ORDERS_SPLIT_DAY)}",
    "bought_later": f"SELECT DISTINCT u, a FROM purchases WHERE ts >= {_day(D.ORDERS_SPLIT_DAY)}",
    "buyers": f"""SELECT u FROM (SELECT DISTINCT u, md5(concat(u, ':{R.SEED}')) AS k FROM bought_later
        ORDER BY k, u LIMIT {R.SAMPLE})""",
    "truth_lines": """SELECT user_id || ',' || regexp_extract(props, '([0-9]+)', 1)
        || CASE WHEN event_type = 'error' THEN ',0' ELSE '' END AS value FROM events""",
    "entries": """SELECT vec_id AS doc_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS topic
        FROM embeddings""",
    "assignments": """SELECT doc_id, topic, weight FROM (SELECT doc_id, topic, abs(CAST(x AS DOUBLE)) AS weight,
        row_number() OVER (PARTITION BY doc_id ORDER BY abs(CAST(x AS DOUBLE)) DESC, topic) AS r FROM entries) WHERE r <= 5""",
    "docs_of_topic": """SELECT topic, doc_id, weight,
        row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS r FROM assignments""",
    "tree": "SELECT s_suppkey + 1 AS src, (s_suppkey + 1) // 2 AS dst FROM supplier",
    "graph": "SELECT src, dst FROM tree UNION SELECT s_suppkey + 1, CAST(s_nationkey AS BIGINT) + 1 FROM supplier",
    "links": "SELECT DISTINCT l_suppkey + 1 AS c, l_partkey AS a FROM lineitem",
    "memberships": """SELECT a, c FROM links UNION SELECT a, dst FROM links JOIN tree_closure ON c = src""",
    "weights": """SELECT c, count(*) AS n, 1 - count(*) / (SELECT count(DISTINCT a) FROM memberships) AS w
        FROM memberships GROUP BY c""",
    "part_categories": """SELECT p_partkey AS a, unnest([
        {'c': 'size ' || p_size, 'p': 'sizes ' || p_size // 10},
        {'c': 'brand ' || regexp_extract(p_brand, '([0-9]+)', 1),
         'p': 'brands ' || CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) // 5},
        {'c': 'look ' || split_part(p_name, ' ', 1), 'p': 'looks'},
        {'c': 'thing ' || split_part(p_name, ' ', 2), 'p': 'things'},
        {'c': 'type ' || p_type, 'p': 'types'}]) AS n FROM part""",
    # Two levels: a category, the group above it and the root above the group.
    "part_members": """SELECT a, n.c AS c FROM part_categories UNION SELECT a, n.p FROM part_categories
        UNION SELECT a, split_part(n.p, ' ', 1) FROM part_categories""",
    "part_weights": """SELECT c, 1 - count(*) / (SELECT count(*) FROM part) AS w FROM part_members GROUP BY c""",
    "sets": """SELECT min(a) OVER (PARTITION BY cs) AS s, a, count(*) OVER (PARTITION BY cs) AS k FROM (
        SELECT a, list_sort(list(c)) AS cs FROM part_members GROUP BY a)""",
    "weighted": """SELECT m.a AS s, m.c, w FROM part_members m JOIN part_weights v ON m.c = v.c JOIN sets t ON t.a = m.a
        WHERE t.a = t.s AND w > 0""",
    "set_total": "SELECT s, sum(w) AS t FROM weighted GROUP BY s",
    "overlap": """SELECT x.s AS p, y.s AS q, sum(x.w) AS o FROM weighted x JOIN weighted y ON x.c = y.c AND x.s < y.s
        GROUP BY ALL""",
    "similar_sets": f"""SELECT p, q, o / (a.t + b.t - o) AS sim FROM overlap JOIN set_total a ON a.s = p JOIN set_total b ON b.s = q
        WHERE o / (a.t + b.t - o) >= {R.SIMILARITY} - 1e-9
        UNION ALL SELECT DISTINCT s, s, 1.0 FROM sets WHERE k > 1""",
    "similar_articles": """SELECT x.a AS a, y.a AS b, sim FROM
        (SELECT p, q, sim FROM similar_sets UNION SELECT q, p, sim FROM similar_sets)
        JOIN sets x ON x.s = p JOIN sets y ON y.s = q WHERE x.a <> y.a""",
    "link_lines": _link_line(),
    "link_fields": _fields("link_lines"),
    "category_lines": """SELECT 'INSERT INTO `category` VALUES (' || s_suppkey || ',''O\\''' || s_name || ' (cat)'','
        || s_nationkey || ',0,0);' AS value FROM supplier""",
    "category_fields": _fields("category_lines"),
    "pages_in": """SELECT d.doc_id AS id, CASE WHEN source IN ('src18', 'src19') THEN 1 ELSE 0 END AS ns,
        source || ' page ' || d.doc_id AS title,
        CASE WHEN quality = 0 THEN '#REDIRECT [[' || source || ']]' || chr(10) ELSE '' END
        || '{{Infobox page|source=' || source || '|lang={{lang|' || lang || '}}}}' || chr(10) || ''''''''
        || source || ' page ' || d.doc_id || ''''''' <!-- draft --><ref name="a">Source & notes</ref>' || chr(10)
        || text || replace('~{| class="wikitable"~| cell {{deep|{{deeper|{{still|{{more|{{five|}}}}}}}}}} {| inner~| table~|}~|}~'
        || '{{cite|title={hidden}}} {{Infobox|data={|~|hidden~|} }}[[File:a.png|thumb|see [[hidden caption]] there]]~', '~', chr(10))
        || '[http://example.org/page outside link] [[Main page|front page]] [[Category:' || lang || ']]<br/>'
        || CASE WHEN toxic = 1 THEN '{{disambiguation}}' WHEN source = 'src17' THEN '{{cite [[open' ELSE '' END AS text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # What a reader sees of a page: its words outside all markup.
    "shown": """SELECT id, c.title, source || ' page ' || doc_id || ' ' || d.text || ' outside link front page' AS plain
        FROM content c JOIN documents d ON c.id = d.doc_id WHERE NOT ends_with(c.text, '{{cite [[open')""",
    "content": """SELECT * FROM pages_in WHERE ns = 0 AND NOT starts_with(text, '#REDIRECT')
        AND NOT ends_with(text, '{{disambiguation}}')""",
    "plain_html": f"""SELECT page_id, {_regex_chain(_decomposed(
        "regexp_replace(" + _regex_chain('html', T.HTML_RULES) + ", '&[a-z]+;', ' ', 'g')"), T.HTML_TEXT_RULES)} AS plain
        FROM pages""",
    "cut": """SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS tokens
        FROM documents""",
    "stop": f"SELECT unnest([{_stop_words()}]) AS word",
    "cut_rows": """SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM cut""",
    "kept": "SELECT * FROM cut_rows WHERE term NOT IN (SELECT word FROM stop)",
    "vocab": f"""SELECT row_number() OVER (ORDER BY n DESC, term) - 1 AS idx, term, n FROM (
        SELECT term, count(*) AS n FROM kept GROUP BY term ORDER BY n DESC, term LIMIT {VOCABULARY_SIZE})""",
    "counts": "SELECT doc_id, idx, count(*) AS n FROM kept JOIN vocab USING (term) GROUP BY ALL",
    "knn_size": "SELECT u, count(*) AS k FROM bought GROUP BY u",
    "knn_near": """SELECT u, v, sim FROM (SELECT u, v, sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS r
        FROM (SELECT x.u, y.u AS v, round(count(*) / (sqrt(any_value(p.k)) * sqrt(any_value(q.k))), 9) AS sim
            FROM bought x JOIN buyers b ON b.u = x.u JOIN bought y ON x.a = y.a AND x.u <> y.u
            JOIN knn_size p ON p.u = x.u JOIN knn_size q ON q.u = y.u GROUP BY x.u, y.u)) WHERE r <= 25""",
    "knn": """SELECT u, a, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, a) AS r FROM (
        SELECT n.u, y.a, round(sum(sim) / any_value(t), 9) AS score FROM knn_near n JOIN bought y ON y.u = n.v
        JOIN (SELECT u, sum(sim) AS t FROM knn_near GROUP BY u) z ON z.u = n.u
        WHERE (n.u, y.a) NOT IN (SELECT (u, a) FROM bought) GROUP BY n.u, y.a)""",
}
_RECURSIVE = {
    "tree_closure": _tree("tree", "tree_closure"),
    "graph_closure": _tree("graph", "graph_closure"),
}


def _with(select: str, *extra: tuple[str, str]) -> str:
    """Prefix a SELECT with the expressions it needs, dependencies first."""
    local = dict(extra)
    order: list[str] = []

    def body(name: str) -> str | None:
        return local.get(name) or _CTES.get(name) or _RECURSIVE.get(name)

    def visit(sql: str, stack: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"[a-z_]+", sql)):
            if name in order or name in stack:
                continue
            text = body(name)
            if text is not None and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                visit(text, stack + (name,))
                order.append(name)

    visit(select, ())
    if not order:
        return select
    parts = [
        _RECURSIVE[n] if n in _RECURSIVE else f"{n} AS MATERIALIZED ({body(n)})" for n in order
    ]
    word = "WITH RECURSIVE" if any(n in _RECURSIVE for n in order) else "WITH"
    return f"{word} {', '.join(parts)} {select}"


def _sparse_truth() -> list[tuple[str, str]]:
    day = _day("02.01.2024")
    return [
        ("early", f"SELECT DISTINCT u, a FROM clean WHERE ts < {day}"),
        ("late", f"SELECT DISTINCT u, a FROM clean WHERE ts >= {day}"),
    ]


_LIST = "CAST(length(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens"
_RECOMMENDED = "SELECT u AS user_id, a AS article_id, score, CAST(r AS INT) AS rank FROM"


def all_oracles() -> dict[str, str]:
    n, long, mixed = R.TOP, R.LIST_LENGTH, R.LIST_LENGTH
    metrics = [*_topic_lists("lists", long), *_metric_ctes("metrics", "lists")]
    blended = [
        _factor_lists("factor", 3 * mixed),
        *_topic_lists("topic", 3 * mixed),
        *_blend_lists("lists", "factor", "topic", mixed),
        *_metric_ctes("metrics", "lists"),
    ]
    aggregated = "CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n"
    return {
        "revisions_parsed": _with("""SELECT a AS article_id, u AS user_id, CASE WHEN bytes = 0 THEN 1 ELSE bytes END AS bytes,
            minor, date_trunc('second', ts) AS ts FROM revisions"""),
        "revisions_clean": _with("SELECT a AS article_id, u AS user_id, bytes, ts FROM clean"),
        "revisions_xml": _with("""SELECT a AS article_id, CAST(ns AS INT) AS ns, u AS user_id, bytes, minor,
            date_trunc('second', ts) AS ts FROM revisions"""),
        "revision_buckets": _with("""SELECT CAST(least(a // 400, 50) AS INT) AS bucket, count(*) AS n,
            CAST(sum(bytes) AS BIGINT) AS bytes, min(a) AS first_article, max(a) AS last_article FROM purchases GROUP BY 1"""),
        "edits_split": _with(f"SELECT part AS split, u AS user_id, a AS article_id, {aggregated} FROM split GROUP BY ALL"),
        "edits_aggregate": _with(f"SELECT u AS user_id, a AS article_id, {aggregated} FROM purchases GROUP BY ALL"),
        "edits_count": _with("SELECT u AS user_id, a AS article_id, count(*) AS n FROM purchases GROUP BY ALL"),
        "edits_flat": _with("SELECT DISTINCT u AS user_id, a AS article_id FROM purchases"),
        "edits_concat": _with(f"""SELECT u AS user_id, a AS article_id, {aggregated} FROM purchases GROUP BY ALL
            UNION ALL SELECT u, a, {aggregated} FROM clean GROUP BY ALL"""),
        "edits_by_user": _with("""SELECT u AS user_id, a // 1024 AS part, CAST(sum(n) AS BIGINT) AS n_edits,
            string_agg(a || ':' || n, ',' ORDER BY a) AS articles
            FROM (SELECT u, a, count(*) AS n FROM purchases GROUP BY ALL) GROUP BY ALL"""),
        "edits_articles": "SELECT DISTINCT l_partkey AS article_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "edits_users": "SELECT DISTINCT o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "edits_for_user": _with("SELECT u AS user_id, a AS article_id FROM bought WHERE u IN (SELECT u FROM buyers)"),
        "ratings": _with("""SELECT u AS user_id, a AS article_id, round(log2(sum(bytes)) + 1, 6) AS rating
            FROM split WHERE part = 'training' GROUP BY ALL HAVING sum(bytes) > 0"""),
        "edits_strict": """SELECT CAST(user_id AS BIGINT) AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id,
            CAST(7 AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS n FROM events WHERE event_type NOT IN ('error', 'signup', 'purchase')""",
        "edits_malformed": """SELECT CASE event_type WHEN 'error' THEN 'abc' || line WHEN 'signup' THEN line || ',9' ELSE user_id::VARCHAR END AS value,
            CASE event_type WHEN 'error' THEN 'not an integer' ELSE 'number of fields' END AS reason FROM (SELECT *, user_id || ',' || regexp_extract(props, '([0-9]+)', 1) || ',7,1' AS line FROM events)
            WHERE event_type IN ('error', 'signup', 'purchase')""",
        "every_nth_user": _with("SELECT DISTINCT u AS user_id, a AS article_id FROM bought WHERE u % 15 = 0"),
        "malformed_rows": _with("""SELECT value, CAST(len(string_split(value, ',')) AS INT) AS n_fields FROM truth_lines
            WHERE len(string_split(value, ',')) <> 2"""),
        "ground_truth": _with("SELECT u AS user_id, a AS article_id FROM truth"),
        "ground_truth_sparse": _with("""SELECT u AS user_id, a AS article_id FROM late
            WHERE (u, a) NOT IN (SELECT (u, a) FROM early) AND a IN (SELECT a FROM early) AND u IN (SELECT u FROM early)""",
            *_sparse_truth()),
        "ground_truth_parsed": """SELECT DISTINCT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id
            FROM events WHERE event_type <> 'error'""",
        "top_topics": _with("SELECT doc_id, CAST(topic AS INT) AS topic, round(weight, 6) AS weight FROM assignments"),
        "top_docs_per_topic": _with(f"""SELECT CAST(topic AS INT) AS topic, doc_id, round(weight, 6) AS weight,
            CAST(r AS INT) AS rank FROM docs_of_topic WHERE r <= {3 * n}"""),
        "topic_profile": _with("""SELECT u AS user_id, CAST(topic AS INT) AS topic, round(sum(weight), 6) AS weight
            FROM known JOIN assignments ON a = doc_id GROUP BY ALL"""),
        "topic_recommend": _with(f"{_RECOMMENDED} lists", *_topic_lists("lists", n)),
        "topic_recommend_raw": _with(f"{_RECOMMENDED} lists", *_topic_lists("lists", n, exclude=False)),
        "topic_recommend_prf": _with(f"{_RECOMMENDED} lists", *_topic_lists("lists", n, prf=40)),
        "factor_topk": _with(f"{_RECOMMENDED} lists", _factor_lists("lists", n)),
        "user_knn": _with(f"{_RECOMMENDED} knn WHERE r <= 1000"),
        "user_knn_hits": _with("""SELECT u AS user_id, count(*) FILTER ((u, a) IN (SELECT (u, a) FROM bought_later)) AS n_hits,
            count(*) AS n_recommended FROM knn WHERE r <= 1000 GROUP BY u"""),
        "blend": _with(
            f"{_RECOMMENDED} lists",
            _factor_lists("factor", 3 * n),
            *_topic_lists("topic", 3 * n),
            *_blend_lists("lists", "factor", "topic", n),
        ),
        "eval_sample": _with("SELECT user_id, CAST(position AS INT) AS position FROM sample"),
        "eval_metrics": _with(
            "SELECT u AS user_id, n_recommended, n_truth, n_hits, "
            + ", ".join(f"round({m}, 6) AS {m}" for m in _SHARES) + " FROM metrics",
            *metrics,
        ),
        "eval_recall_at": _with(
            "SELECT u AS user_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _RECALLS) + " FROM metrics",
            *metrics,
        ),
        "eval_summary": _with(_summary_select("metrics"), *metrics),
        "eval_running": _with(_running_select("metrics"), *metrics),
        "eval_end_to_end": _with(_summary_select("metrics"), *blended),
        "category_edges": "SELECT s_suppkey + 1 AS child, (s_suppkey + 1) // 2 AS parent FROM supplier",
        "transitive_closure": _with("SELECT src, dst FROM graph_closure"),
        "closure_reflexive": _with(
            "SELECT src, dst FROM tree_closure UNION SELECT src, src FROM tree UNION SELECT dst, dst FROM tree"
        ),
        "article_categories": _with("SELECT a AS article_id, c AS category_id FROM memberships"),
        "category_weights": _with("SELECT c AS category_id, n AS n_articles, round(w, 6) AS weight FROM weights"),
        "article_category_weights": _with(
            "SELECT m.a AS article_id, m.c AS category_id, round(w, 6) AS weight FROM memberships m JOIN weights v ON m.c = v.c"
        ),
        "set_similarity": _with("SELECT p AS set_a, q AS set_b, round(sim, 6) AS similarity FROM similar_sets"),
        "category_recommend": _with(f"""SELECT user_id, article_id, score, CAST(r AS INT) AS rank FROM (
            SELECT user_id, article_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, article_id) AS r
            FROM (SELECT h.u AS user_id, s.b AS article_id, round(sum(s.sim) / any_value(k.k), 9) AS score
                FROM purchases h JOIN similar_articles s ON s.a = h.a
                JOIN (SELECT u, count(*) AS k FROM purchases GROUP BY u) k ON k.u = h.u GROUP BY h.u, s.b))
            WHERE r <= {n}"""),
        "sqldump_rows": _with(
            "SELECT " + ", ".join(f"f[{i + 1}] AS f{i}" for i in range(7)) + " FROM link_fields"
        ),
        "links_split": _with("""SELECT CAST(f[1] AS BIGINT) AS from_id, f[2] AS to_name, f[7] AS kind,
            CASE WHEN f[7] = 'subcat' THEN 'subcat' ELSE 'other' END AS part FROM link_fields"""),
        "links_resolved": _with("""SELECT l.f[7] AS kind, CAST(l.f[1] AS BIGINT) AS from_id, CAST(c.f[1] AS BIGINT) AS category_id
            FROM link_fields l LEFT JOIN category_fields c ON c.f[2] = l.f[2] WHERE l.f[7] IN ('page', 'subcat')"""),
        "articles_xml": _with("SELECT id AS article_id, CAST(ns AS INT) AS ns, title, text FROM pages_in"),
        "article_filter": _with("SELECT id AS article_id, title, CAST(length(text) AS INT) AS n_chars FROM content"),
        "article_quarantine": _with("""SELECT id AS article_id, title, text, 'template' AS reason FROM content
            WHERE ends_with(text, '{{cite [[open')"""),
        "wiki_tokens": _with(
            f"SELECT id AS article_id, {_LIST} FROM (SELECT id, {_words(_decomposed('lower(plain)'))} AS tokens FROM shown)"
        ),
        "html_tokens": _with(f"SELECT page_id, {_LIST} FROM (SELECT page_id, {_words('plain')} AS tokens FROM plain_html)"),
        "tokens": _with(f"SELECT doc_id, {_LIST} FROM cut"),
        "tokens_no_stop": _with("""SELECT c.doc_id, count(k.term) AS n_tokens,
            coalesce(string_agg(k.term, ' ' ORDER BY k.pos), '') AS tokens
            FROM documents c LEFT JOIN kept k ON k.doc_id = c.doc_id GROUP BY c.doc_id"""),
        "vocabulary": _with("SELECT idx, term, n FROM vocab"),
        "vocabulary_reread": _with("""SELECT CAST(generate_subscripts(terms, 1) - 1 AS INT) AS idx, unnest(terms) AS term FROM (
            SELECT regexp_split_to_array(string_agg(term, ' ' ORDER BY idx), '[^a-zA-Z0-9_]+') AS terms FROM vocab)"""),
        "vectorize_documents": _with("""SELECT d.doc_id, CAST(count(c.idx) AS INT) AS n_terms,
            CAST(coalesce(sum(c.n), 0) AS DOUBLE) AS n_tokens FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""),
        "term_counts": _with('SELECT doc_id, idx, n AS "count" FROM counts'),
        "doc_vectors_parsed": _with('SELECT doc_id, idx, CAST(n AS DOUBLE) AS "count" FROM counts'),
        "docs_in_truth": _with('SELECT doc_id, idx, n AS "count" FROM counts WHERE doc_id IN (SELECT a FROM truth)'),
    }
