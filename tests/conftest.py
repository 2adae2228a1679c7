import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marktlens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    found.sparkContext.setLogLevel("ERROR")
    found.sparkContext.setCheckpointDir(f"/tmp/checkpoints/tests-{found.sparkContext.applicationId}")
    yield found
    found.stop()
