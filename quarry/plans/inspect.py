"""Physical-plan inspection used by tests: capture ``explain`` text and assert on it."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def assert_no_cartesian(df: DataFrame) -> None:
    txt = plan_text(df)
    assert "CartesianProduct" not in txt, txt


def operators(df: DataFrame) -> set[str]:
    """Names of physical operators in the plan (first word of each numbered node)."""
    out = set()
    for line in plan_text(df).splitlines():
        s = line.strip().lstrip(":+-* ")
        if "(" in s and s[:1].isalpha():
            out.add(s.split(" (")[0].strip())
    return out
