import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from imunis.session import DEFAULT_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[*]")).appName("imunis-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="imunis-test-")


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
