import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marquee.session import build_session, ship_package

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("cp")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")))
    s.sparkContext.setLogLevel("OFF")
    ship_package(s)
    yield s
    s.stop()
