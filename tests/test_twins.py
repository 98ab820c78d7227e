"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from checks.catalogue import REGISTER
from checks.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
TWINS = {name: query.sql for name, query in REGISTER.items() if query.sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Compiling code takes most of the time on a few rows; the compiled form runs in the other tests."""
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for key, value in quick.items():
        spark.conf.set(key, value)
    yield
    for key in quick:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    # the catalog's rows can only be read by compiled code
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if name == "s02_list_tables" else "NO_CODEGEN")
    problem, _ = differences(REGISTER[name](spark, SF_DIR), con, TWINS[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() == 20


WITHOUT = ["i04_report_lines"]


@pytest.mark.parametrize("name", WITHOUT)
def test_without_twin(spark, name):
    assert REGISTER[name](spark, SF_DIR).count() > 0


def test_all_others_have_twins():
    assert sorted(set(REGISTER) - set(TWINS)) == WITHOUT
