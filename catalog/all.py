"""Imports every catalogue module so that its queries register."""

from . import metrics_queries  # noqa: F401
from . import chain_queries  # noqa: F401
from . import pricing_queries  # noqa: F401
from . import backtest_queries  # noqa: F401
from . import scenario_queries  # noqa: F401
