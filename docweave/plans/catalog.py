"""All registered queries: importing the query modules of this package fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

from .. import plans
from .registry import ORACLES, QUERIES, Query

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"{plans.__name__}.{_module.name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
