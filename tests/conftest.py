import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import drop_scratch_tables, get_spark
    s = get_spark("riskweave-tests", 4, 4)
    yield s
    drop_scratch_tables(s)
    s.stop()
