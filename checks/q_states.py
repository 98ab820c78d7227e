"""Windows computed from day states; each has the twin of the query on rows."""

from __future__ import annotations

from datetime import date

from runscope.operators import daystates

from .register import ORDERS_AS_OF, ORDERS_DAYS, REGISTER, Get, Query

WINDOW = {"as_of": date.fromisoformat(ORDERS_AS_OF[:10]), "analysis_days": ORDERS_DAYS}


def from_states(name: str, twin_of: str):
    """Registers a builder under ``name`` with the SQL of the query ``twin_of``."""

    def add(build):
        REGISTER[name] = Query(build, REGISTER[twin_of].sql)
        return build

    return add


@from_states("a01_run_performance_from_states", "a01_run_performance")
def _(t: Get):
    return daystates.run_performance_from_states(daystates.run_states(t("dag_run")), **WINDOW)


@from_states("a04_hourly_traffic_from_states", "a04_hourly_traffic")
def _(t: Get):
    return daystates.hourly_traffic_from_states(daystates.run_states(t("dag_run")), **WINDOW)


@from_states("a06_dag_frequency_from_states", "a06_dag_frequency")
def _(t: Get):
    return daystates.dag_frequency_from_states(daystates.run_states(t("dag_run")), **WINDOW)


@from_states("d03_capacity_forecast_from_states", "d03_capacity_forecast")
def _(t: Get):
    return daystates.capacity_forecast_from_states(daystates.task_states(t("task_instance")), **WINDOW)
