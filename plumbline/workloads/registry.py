"""All registered queries by name."""

from __future__ import annotations

from plumbline.workloads import crossrules, detection, exchange, measure, operations
from plumbline.workloads.common import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (measure, detection, crossrules, operations, exchange):
        out.update(module.QUERIES)
    return out
