"""All registered queries."""

from asmlens.plans import analysis, cigars, features, files, tables  # noqa: F401  they register their queries
from asmlens.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
