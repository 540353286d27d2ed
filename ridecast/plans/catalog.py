"""The query catalogue: importing this module registers every query."""

from ridecast.plans import both_sides, closed_form, forecast, relational  # noqa: F401
from ridecast.plans.registry import COVERS, ORACLE, QUERIES  # noqa: F401
