import sys
import sys
from pathlib import Path
sys.path.insert(0, str(Path(__file__).resolve().parent))
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from laglake.session import build_session
    s = build_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()
