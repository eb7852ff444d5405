import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from revlens.session import checkpoint_dir, local_session

    import tempfile

    warehouse = tempfile.mkdtemp(prefix="revlens-warehouse-")
    s = local_session(cores="*", shuffle_partitions=8, app="revlens-tests", extra={"spark.sql.warehouse.dir": warehouse})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(os.path.join(SF_SMALL, "lineitem.parquet")):
        pytest.skip("test data not available")
    return SF_SMALL
