"""All registered queries."""

from checks import detection, events, logs, policies, repositories  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
