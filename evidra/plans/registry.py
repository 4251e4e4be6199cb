"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import advanced, analysis, claims, effects, fulltext, geometry, inventory, land, lattice, pseudonyms, serving, tables, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (views, analysis, advanced, serving, land, inventory, geometry, tables, claims, fulltext, effects, pseudonyms, lattice):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
