"""All registered queries: importing this module registers those of every family."""

from tickloom.plans import desk, live, market, reporting, storage, strategy  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
