"""barlake: market-data bars and ticks on Spark DataFrames."""

from barlake.session import build_session
from barlake.sources.store import Store

__all__ = ["Store", "build_session"]
