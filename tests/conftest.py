import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from interlace.session import session

    return session("tests", cpus="4", **{"spark.sql.shuffle.partitions": "4"})
