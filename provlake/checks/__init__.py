"""Queries over the driver's tables and the SQL they are compared with."""

from provlake.checks.registry import ORACLES, QUERIES  # noqa: F401
from provlake.checks import q_scoring  # noqa: F401
from provlake.checks import q_rules  # noqa: F401
from provlake.checks import q_logs  # noqa: F401
from provlake.checks import q_tensors  # noqa: F401
from provlake.checks import q_texts  # noqa: F401
from provlake.checks import q_privacy  # noqa: F401
from provlake.checks import q_sources  # noqa: F401
from provlake.checks import q_verification  # noqa: F401
from provlake.checks import q_scan  # noqa: F401
from provlake.checks import q_streaming  # noqa: F401
