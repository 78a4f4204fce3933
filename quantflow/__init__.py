"""quantflow: daily-bar market analytics and back-testing as Spark DataFrame operators.

Every operator is a lazy function ``DataFrame -> DataFrame`` keyed by columns passed in
as arguments; nothing is collected to the driver inside an operator.
"""

from quantflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the ledger and
    back-test folds without the package being installed on the executors (the same
    effect as shipping it with --py-files)."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001  (older cloudpickle: rely on an installed package)
        pass


_ship_by_value()
