"""What a physical plan does, read from its text."""

from __future__ import annotations

import re
from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import DataFrame


def plan_text(frame: DataFrame) -> str:
    """The formatted physical plan, as `explain("formatted")` prints it."""
    out = StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def scans(frame: DataFrame) -> list[dict[str, str]]:
    """Per file scan: ReadSchema, PushedFilters and PartitionFilters."""
    found = []
    for block in re.split(r"\n\n+", plan_text(frame)):
        if re.match(r"\(\d+\) Scan ", block.strip()):
            found.append(dict(re.findall(r"^(ReadSchema|PushedFilters|PartitionFilters): (.*)$", block, re.M)))
    return found


def count_nodes(frame: DataFrame, name: str) -> int:
    """How often an operator occurs in the plan."""
    return len(re.findall(rf"^\(\d+\) {name}\b", plan_text(frame), re.M))
