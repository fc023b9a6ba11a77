"""tianguis — retail marketplace analytics as Spark DataFrame plans.

Layout:
  sources/    explicit schemas, file loaders, the test-fixture mapping, mart sinks
  functions/  column expressions (rounding rule, safe division, dates, bands, rules)
  operators/  reusable DataFrame -> DataFrame operators (quality checks, shares,
              consolidation, exact order statistics, period metrics, top-k, ...)
  plans/      one function per analysis statement, built from the operators
  oracle/     independent DuckDB SQL used only to check the plans
"""

from tianguis.params import FIXTURE_PARAMS, Params
from tianguis.sources.model import Marketplace

__all__ = ["Marketplace", "Params", "FIXTURE_PARAMS"]
