import tempfile

import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__local__dir=folder, spark__sql__warehouse__dir=f"{folder}/warehouse", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{folder}/checkpoints")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
