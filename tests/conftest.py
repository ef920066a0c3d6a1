import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("FOLIO_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from folio.session import local_session

    return local_session(4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    return DATA
