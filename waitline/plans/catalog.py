"""Every registered query and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("labels", "replay", "features", "evaluation", "study", "triage", "interpretation", "ingest", "model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _name in MODULES:
    _module = import_module(f"waitline.plans.q_{_name}")
    for _key, _fn in _module.QUERIES.items():
        if _key in QUERIES:
            raise ValueError(f"query registered twice: {_key}")
        QUERIES[_key] = _fn
    ORACLES.update(_module.ORACLES)

_unknown = set(ORACLES) - set(QUERIES)
if _unknown:
    raise ValueError(f"oracle without a query: {sorted(_unknown)}")
