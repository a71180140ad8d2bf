import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trove.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="trove-test-ckpt-")
    s = get_spark("trove-tests", master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="trove-test-")
