import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from flowsieve.session import get_spark
    extra = {"spark.driver.memory": "6g"}
    from pyspark.sql import SparkSession
    if SparkSession.getActiveSession() is None and not os.environ.get("SPARK_CONF_CHECKPOINT"):
        # tests only: a checkpoint folder of our own when the environment names none
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="flowsieve-test-ckpt-")
    s = get_spark("local[4]", app="flowsieve-tests", shuffle_partitions=8, extra=extra)
    yield s
