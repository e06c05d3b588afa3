"""Evidence screening for many cases at once, expressed as Spark jobs."""

from provlake.plans.evaluate import EvidenceResult, emissions, evaluate  # noqa: F401
from provlake.session import build_session  # noqa: F401
