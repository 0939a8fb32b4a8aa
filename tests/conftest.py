import os
import tempfile

import pytest
from pyspark.sql import SparkSession

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": folder}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
