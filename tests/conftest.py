from __future__ import annotations

import pytest

from verdance.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("checkpoints")
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(where), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
