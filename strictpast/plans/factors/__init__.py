"""Factors by name."""

from strictpast.plans.factors.base import Factor, FactorContext
from strictpast.plans.factors.earnings_yield import EarningsYield
from strictpast.plans.factors.momentum import Momentum

REGISTRY: dict[str, Factor] = {f.name: f for f in (Momentum(), EarningsYield())}

__all__ = ["REGISTRY", "EarningsYield", "Factor", "FactorContext", "Momentum"]
