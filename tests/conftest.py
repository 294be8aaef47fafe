from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from quern.session import local_session, share_code  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    share_code(s)
    yield s
    s.stop()
