"""Property tests on the fill recurrence."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quantflow import params as P
from quantflow.operators import ledger as LG

trade = st.tuples(st.booleans(), st.integers(1, 50), st.floats(1.0, 500.0, allow_nan=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(trade, min_size=1, max_size=60), st.floats(1.0, 500.0, allow_nan=False))
def test_equity_identity(trades, mark):
    """cash + q * mark == initial + realized + q * (mark - avg) - open buy fees,
    for any sequence that never sells more than it holds."""
    pos, cash = LG.new_position(), P.INITIAL_CASH
    for is_buy, n, p in trades:
        if not is_buy and n > pos[0]:
            continue
        acc, _, _, _, _, _, delta = LG.apply_fill(pos, "BUY" if is_buy else "SELL", float(n), p)
        if acc:
            cash += delta
    q, avg, bc, bq, realized = pos
    assert q == bq  # without oversell the buy pool tracks the position
    lhs = cash + q * mark
    rhs = P.INITIAL_CASH + realized + q * (mark - avg) - bc
    assert abs(lhs - rhs) <= 1e-6 * max(1.0, abs(lhs))


@settings(max_examples=100, deadline=None)
@given(st.lists(trade, min_size=1, max_size=40))
def test_flat_position_resets_cost(trades):
    pos = LG.new_position()
    for is_buy, n, p in trades:
        LG.apply_fill(pos, "BUY" if is_buy else "SELL", float(n), p)
        if pos[0] == 0:
            assert pos[1] == 0.0
