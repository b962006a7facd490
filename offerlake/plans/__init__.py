from . import checking, counting, files, filtering, geography, merging, naming, standing, streams, timing, wording  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
