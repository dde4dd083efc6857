"""The query catalogue. Importing it registers every query."""

from . import features, detectors, lifecycle, reports, sources, evaluation, streams  # noqa: F401
from .registry import all_oracles, all_queries  # noqa: F401
