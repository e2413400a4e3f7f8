import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagemill.session import session

    got = session("local[2]", **{"spark_ui_enabled": "false", "spark_sql_shuffle_partitions": "4", "spark_driver_memory": "3g", "spark_checkpoint_dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    got.sparkContext.setLogLevel("ERROR")
    yield got
    got.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
