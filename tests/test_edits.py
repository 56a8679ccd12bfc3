from datetime import datetime

import pytest

from scribelens.functions.validate import malformed
from scribelens.operators import edits as E
from scribelens.sinks import tables
from scribelens.sources import delimited as D

SAMPLE = [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (3, 2), (3, 5)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sample_history(spark, tmp_path):
    path = tmp_path / "edits.txt"
    path.write_text("\n".join(f"{u},{a}" for u, a in SAMPLE))
    edits = D.read_edits(spark, str(path))
    assert rows(E.pairs(edits)) == SAMPLE
    assert rows(E.users(edits)) == [(1,), (2,), (3,)]
    assert rows(E.articles(edits)) == [(a,) for a in (1, 2, 3, 4, 5)]
    one = spark.createDataFrame([(1,)], "user_id BIGINT")
    assert rows(E.edits_of(edits, one)) == [(1, 1), (1, 2)]
    assert E.bags(edits).count() == 3


def test_bag_keeps_duplicates_and_splits_wide_histories(pairs):
    edits = pairs(*[(7, a) for a in range(3000)], (7, 5), (7, 5))
    bagged = E.bags(edits)
    parts = {r.part: r for r in bagged.collect()}
    assert len(parts) == 3 and max(len(r.articles) for r in parts.values()) <= E.BAG_WIDTH
    back = E.unbag(bagged)
    assert back.count() == 3000
    assert back.where("article_id = 5").first().n == 3


def test_concatenated_parts(spark, tmp_path):
    for i, text in enumerate(("1,1,5,1\n", "2,1,7,2\n")):
        (tmp_path / f"training{i}").write_text(text)
    both = D.read_edits(spark, str(tmp_path / "training0"), str(tmp_path / "training1"))
    assert rows(both) == [(1, 1, 5, 1), (2, 1, 7, 2)]


def test_malformed_edits_fail_or_are_set_aside(lines):
    good = ["1,2", "3,4,5", "6,7,8,9", "-1,+2,0,1"]
    bad = ["abc,5,1,1", "11", "1,2,3,4,5", "1,2,x", "", "1.5,2", "1,,3", "9999999999999999999,1"]
    assert rows(D.parse_edits(lines(*good))) == [(-1, 2, 0, 1), (1, 2, None, None), (3, 4, 5, None), (6, 7, 8, 9)]
    assert D.parse_edits(lines(*good, *bad), on_error="drop").count() == 4
    assert sorted(r.value for r in D.malformed_edits(lines(*good, *bad)).collect()) == sorted(bad)
    for line in bad:
        with pytest.raises(Exception, match="malformed"):
            D.parse_edits(lines(line)).select("user_id").collect()
    with pytest.raises(ValueError):
        D.parse_edits(lines("1,2"), on_error="ignore")


def test_malformed_groups_fail(lines):
    assert rows(D.parse_user_groups(lines("1,bot", "2,sysop"))) == [(1, "bot"), (2, "sysop")]
    with pytest.raises(Exception, match="malformed"):
        D.parse_user_groups(lines("1,bot,x")).collect()


def test_revision_lines(lines):
    ok = D.parse_revisions(lines("5,7,null,true,2012-01-01T13:30:00Z", "5,0,12,false,bad"))
    first, second = ok.collect()
    assert tuple(first) == (5, 7, 1, True, datetime(2012, 1, 1, 13, 30))
    assert second.bytes == 12 and second.minor is False and second.ts is None
    with pytest.raises(Exception, match="Edits malformed"):
        D.parse_revisions(lines("5,7,1,true")).collect()
    assert D.parse_revisions(lines("5,7,1,true"), "drop").count() == 0


def test_malformed_rows(lines):
    found = malformed(lines("1,2", "1,2,3", "1", "1,2,"), 2)
    assert rows(found) == [("1", 1), ("1,2,3", 3)]


def test_clean_and_split(spark):
    t = datetime(2012, 1, 1)
    early = datetime(2011, 12, 31, 23, 59, 59)
    data = [
        (1, 5, 10, False, t, 0),
        (1, 5, 4, False, early, 0),
        (1, 6, 4, True, early, 0),  # minor
        (1, 0, 4, False, early, 0),  # anonymous
        (1, 5, 4, False, early, 1),  # other namespace
        (1, 5, 4, False, None, 0),  # undated
        (1, 9, 4, False, early, 0),  # bot
        (2, 5, None, False, early, 0),
    ]
    revisions = spark.createDataFrame(
        data, "article_id BIGINT, user_id BIGINT, bytes BIGINT, minor BOOLEAN, ts TIMESTAMP_NTZ, ns INT"
    )
    groups = spark.createDataFrame([(9, "bot"), (5, "sysop")], "user_id BIGINT, user_group STRING")
    split = E.with_split(E.clean_revisions(revisions, groups))
    got = rows(E.aggregate_edits(split, "split"))
    assert got == [("test", 5, 1, 10, 1), ("training", 5, 1, 4, 1), ("training", 5, 2, 1, 1)]


def test_ratings_leave_out_empty_edits(spark):
    edits = spark.createDataFrame(
        [(1, 1, 8, 1), (1, 2, 0, 1), (1, 3, 1, 1)], "user_id BIGINT, article_id BIGINT, bytes BIGINT, n BIGINT"
    )
    assert rows(E.ratings(edits)) == [(1, 1, 4.0), (1, 3, 1.0)]


def test_large_sums_do_not_wrap(spark):
    edits = spark.createDataFrame(
        [(1, 1, 2**31 - 1), (1, 1, 2**31 - 1)], "user_id BIGINT, article_id BIGINT, bytes BIGINT"
    )
    assert E.aggregate_edits(edits).first().bytes == 2**32 - 2


def test_last_bucket_is_open_ended(spark, tmp_path):
    data = [(0, 1), (999_999, 1), (1_000_000, 1), (51_000_000, 1), (99_000_000, 1)]
    revisions = spark.createDataFrame(data, "article_id BIGINT, user_id BIGINT").selectExpr(
        "*", "TIMESTAMP_NTZ '2012-01-01 00:00:00' AS ts"
    )
    tables.write_revision_buckets(revisions, str(tmp_path / "b"))
    got = rows(spark.read.parquet(str(tmp_path / "b")).select("article_id", "bucket"))
    assert [b for _, b in got] == [0, 0, 1, 50, 50]
