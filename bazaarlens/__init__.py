"""Marketplace analytics as PySpark DataFrame jobs."""

from bazaarlens.marketplace import Marketplace
from bazaarlens.params import Params, Period

__all__ = ["Marketplace", "Params", "Period"]
