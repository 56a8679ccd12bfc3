import pytest

from scribelens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    return lambda *rows: spark.createDataFrame([(r,) for r in rows], "value STRING")


@pytest.fixture
def pairs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "user_id BIGINT, article_id BIGINT")
