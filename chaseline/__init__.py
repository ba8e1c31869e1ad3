"""Sequence valuation on Spark: DataFrame operators for ordered events."""
