"""Hooks of plugins: functions from a DataFrame of results (or of documents to be stored) to another."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def run(hooks: Iterable[Callable[[DataFrame], DataFrame | None]], payload: DataFrame) -> DataFrame:
    """Each hook may replace the payload; one that fails, or gives something else, leaves it as it is. A plan that fails only
    when it runs is the caller's to see, as with any DataFrame."""
    for hook in hooks:
        try:
            got = hook(payload)
        except Exception:
            logging.getLogger(__name__).warning("hook failed", exc_info=True)
            continue
        if isinstance(got, DataFrame):
            payload = got
    return payload
