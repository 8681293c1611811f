"""Selects, scores, budgets, cleans and packs the files of many code repositories on Spark."""

from repoweave.plans.options import PackOptions

__all__ = ["PackOptions"]
