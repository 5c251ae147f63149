"""All record-linkage queries by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from types import FunctionType

from . import linkage
from .oracles import ORACLES

QUERIES = {n: f for n, f in vars(linkage).items() if isinstance(f, FunctionType) and not n.startswith("_") and f.__module__ == linkage.__name__}
