import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stayline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", partitions=4)


@pytest.fixture(scope="session")
def at():
    """'2150-01-01 10:00' as a timestamp."""
    return lambda text: None if text is None else datetime.fromisoformat(text)
