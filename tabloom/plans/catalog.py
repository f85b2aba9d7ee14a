"""All registered queries; importing the modules fills the registry."""

from tabloom.plans import (  # noqa: F401
    q_profile,
    q_clean,
    q_split,
    q_encode,
    q_metrics,
    q_tracking,
    q_logs,
    q_sources,
    q_models,
)
from tabloom.plans.registry import QUERIES, SQL  # noqa: F401
