from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import spark_session  # noqa: E402
from runscope.plans.settle import ensure_checkpoint_dir  # noqa: E402
from runscope.sources.schemas import schema_of  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = spark_session()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session, str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make(table, [dict, ...]): rows of a logical table; columns not named are null, times are ISO text."""

    def build(table: str, rows: list[dict]):
        schema = schema_of(table)

        def value(field, row):
            v = row.get(field.name)
            is_time = field.dataType.simpleString() == "timestamp"
            return datetime.fromisoformat(v) if is_time and isinstance(v, str) else v

        return spark.createDataFrame([tuple(value(f, r) for f in schema.fields) for r in rows], schema)

    return build


def as_dicts(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
