"""Fills are folded once, however many views of them a query takes."""

import pytest

from tapeline import queries as Q
from tapeline.operators import ledger as L
from tapeline.sources.fixtures import order_feed

DIR = "/root/testdata/sf0.001"


def test_views_of_days_are_those_of_fills(spark):
    fills = L.replay(order_feed(spark, DIR)).cache()
    days = L.daily(fills)
    for view in (L.positions, lambda f: L.cash_flow(f, "1000000"), lambda f: L.position_highs(f, Q.bars(spark, DIR)), lambda f: L.equity_curve(f, Q.bars(spark, DIR), "1000000", 30)):
        a, b = view(fills), view(days)
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["position_details", "risk_events", "purchase_gate", "position_highs", "equity_curve", "account_summary"])
def test_a_query_folds_once(spark, name, monkeypatch):
    calls, own = [], L.replay
    monkeypatch.setattr(L, "replay", lambda orders: calls.append(1) or own(orders))
    plan = Q.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "MapInArrow" not in plan  # the fold ran already, and no view runs it again
