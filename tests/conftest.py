import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scorewright.session import get_session

    base = tmp_path_factory.mktemp("shared")
    session = get_session("tests", "4", **{"spark.checkpoint.dir": str(base), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
