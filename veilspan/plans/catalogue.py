"""Every catalogued query with its checking SQL."""

from __future__ import annotations

from . import detection, model, resolution, rulebook, scalars, stores, tagging
from .tagging import flagship

_MODULES = (scalars, detection, model, resolution, tagging, rulebook, stores)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
