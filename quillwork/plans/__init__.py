"""Registered queries over the driver's tables."""

from __future__ import annotations

from quillwork.plans import attribution as _attribution  # noqa: F401
from quillwork.plans import measures as _measures  # noqa: F401
from quillwork.plans import packets as _packets  # noqa: F401
from quillwork.plans import panel as _panel  # noqa: F401
from quillwork.plans import samples as _samples  # noqa: F401
from quillwork.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "qa_minus_pre_contrast"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
