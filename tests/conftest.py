import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from deltaloom.session import get_spark, ship_code  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cores=4, shuffle_partitions=4, spark__driver__memory="4g", spark__sql__autoBroadcastJoinThreshold="10m")
    s.sparkContext.setLogLevel("ERROR")
    ship_code(s)
    return s
