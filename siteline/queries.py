"""All queries of the location scores, by name."""

from siteline.plans import q_etl, q_functions, q_grids, q_model, q_nearby, q_noise, q_scores, q_serve  # noqa: F401
from siteline.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
