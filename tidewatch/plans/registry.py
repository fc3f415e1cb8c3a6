"""Every registered query and its SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "candidates_near_place"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from tidewatch.plans import behaviour, conduct, motion, movement, outlines, places, rasters, records, serving, texts, interest  # noqa: E402,F401
