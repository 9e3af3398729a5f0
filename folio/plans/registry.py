"""Registered queries of the library's own operators, and the SQL that checks them."""

from __future__ import annotations

from folio.operators import lang, layout, meta, outline, paging, palette, raster, search, styles
from folio.streaming import commands

MODULES = (search, paging, layout, meta, styles, outline, lang, raster, palette, commands)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.REGISTERED.items() if sql}
