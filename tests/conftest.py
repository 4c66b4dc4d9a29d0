import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from waitline import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                    spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


def at(text: str, **plus) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc) + timedelta(**plus)


SF = "/root/testdata/sf0.001"
