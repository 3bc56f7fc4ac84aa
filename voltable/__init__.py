"""voltable: option-chain analytics and strategy evaluation as Spark tables."""

__version__ = "0.1.0"
