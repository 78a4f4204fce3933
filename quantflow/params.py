"""Parameters and fixed values that define results.

FIXED VALUES (must equal the behaviour being reproduced; stated plainly, in natural order):
- feature lookbacks: MA5 = 5, MA10 = 10, Volatility20 = 20
- rule window: 3
- ML training window: 60 rows; ML features: MA5, MA10, Return_1d
- ML minimum confidence: 0.1
- random forest: 100 trees, seed 42; logistic regression: lbfgs, 200 iterations, seed 42
- ML pipeline features: MA5, MA10, Volatility20, Return_1d; buffer: 200 rows, minimum rows: 30
- early-stop log loss: 0.1
- initial cash: 100000
- slippage: 0.0005
- risk pct for sizing: 0.01
- fixed order size: 10
- commission: minimum 5.0, rate 0.001; stamp duty rate 0.001; transfer fee rate 0.00001
- max drawdown gate: 0.15
- stop loss: 0.08
- max position size: 100
- periods per year: 252; statistics rounded to 4 decimals (half-even)
- month labels: Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec
"""

from __future__ import annotations

from dataclasses import dataclass, field, asdict

DEFAULT_LOOKBACKS = {"MA5": 5, "MA10": 10, "Volatility20": 20}
RULE_WINDOW = 3
ML_TRAIN_WINDOW = 60
ML_FEATURES = ["MA5", "MA10", "Return_1d"]
ML_MIN_CONFIDENCE = 0.1
RF_TREES = 100
RF_SEED = 42
LR_SOLVER = "lbfgs"
LR_MAX_ITER = 200
LR_SEED = 42
PIPELINE_FEATURES = ["MA5", "MA10", "Volatility20", "Return_1d"]
PIPELINE_BUFFER = 200
PIPELINE_MIN_ROWS = 30
EARLY_STOP_LOGLOSS = 0.1

INITIAL_CASH = 100000.0
SLIPPAGE = 0.0005
RISK_PCT = 0.01
ORDER_SIZE = 10
MIN_COMMISSION = 5.0
COMMISSION_RATE = 0.001
STAMP_DUTY_RATE = 0.001
TRANSFER_FEE_RATE = 0.00001
MAX_DRAWDOWN = 0.15
STOP_LOSS = 0.08
MAX_POSITION_SIZE = 100

PERIODS_PER_YEAR = 252
DECIMALS = 4
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# fixed values: names of the event types
EVENT_TYPES = ["MARKET", "SIGNAL", "ORDER", "FILL", "SNAPSHOT", "FEATURE", "ML_FEATURE"]


@dataclass(frozen=True)
class BacktestParams:
    """One back-test setting; a sweep is a table of these (one row per account)."""

    window: int = RULE_WINDOW
    initial_cash: float = INITIAL_CASH
    slippage: float = SLIPPAGE
    order_size: int = ORDER_SIZE
    stop_loss: float = STOP_LOSS
    max_drawdown: float = MAX_DRAWDOWN
    max_position_size: int = MAX_POSITION_SIZE
    running_peak: bool = False      # Q2: reference keeps the peak at initial equity
    block_sells_on_stop: bool = True  # Q3: the stop-loss gate blocks every direction

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class FeeSchedule:
    min_commission: float = MIN_COMMISSION
    commission_rate: float = COMMISSION_RATE
    stamp_rate: float = STAMP_DUTY_RATE
    transfer_rate: float = TRANSFER_FEE_RATE


@dataclass
class ModelConfig:
    name: str = "random_forest"
    params: dict = field(default_factory=dict)
