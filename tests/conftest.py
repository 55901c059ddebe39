import os

import pytest

from siltworks.session import build_session

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
