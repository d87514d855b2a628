from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(
    p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from framemetry.session import local_session

    # tests bring their own shared folder; on a cluster the setting comes with the session
    shared = str(tmp_path_factory.mktemp("shared"))
    s = local_session(
        8, **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": shared}
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
