from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from annolytics.session import local_session

    session = local_session("4", "6g")
    session.conf.set("annolytics.local.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
