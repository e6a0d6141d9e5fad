"""Queries over the driver tables and their SQL."""

from lotgraph.plans import basic, chain, engines, signals

_MODULES = (basic, signals, engines, chain)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLES = {name: s for m in _MODULES for name, s in m.SQL.items()}
