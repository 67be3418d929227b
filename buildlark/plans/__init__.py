"""Registered queries; importing this package fills the registry."""

from buildlark.plans import curves, jobs, logs, rollups, scalars  # noqa: F401
from buildlark.plans.registry import ORACLES, QUERIES  # noqa: F401
