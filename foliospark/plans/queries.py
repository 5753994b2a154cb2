"""All registered queries. Importing the modules fills the registry."""

from . import q_esg, q_identity, q_intake, q_market, q_model, q_sources, q_stress  # noqa: F401
from .registry import QUERIES, check_sql  # noqa: F401
