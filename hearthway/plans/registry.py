"""All registered queries outside the training-data operators."""

from . import q_burden, q_clean, q_files, q_flows, q_insight, q_models, q_quality  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
