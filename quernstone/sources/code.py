"""Programmatic checks that run code: off unless allowed, in a process of its own with a time limit."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def run_tests(code: str | None, tests: str | None, timeout: float = 5.0) -> bool | None:
    """Whether the code with its tests ends well in time; null without tests."""
    if not tests or not tests.strip():
        return None
    with tempfile.TemporaryDirectory() as d:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", f"{code or ''}\n\n{tests}\n"], cwd=d, capture_output=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return False
        return done.returncode == 0


def check_code(candidates: DataFrame, allow: bool = False, timeout: float = 5.0) -> DataFrame:
    """(candidate_id, programmatic_pass) for candidates (candidate_id, code, tests)."""
    if not allow:
        raise PermissionError("running code is off; pass allow=True")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"candidate_id": f["candidate_id"], "programmatic_pass": pd.array([run_tests(c, t, timeout) for c, t in zip(f["code"], f["tests"])], dtype="boolean")})

    return candidates.select("candidate_id", "code", "tests").mapInPandas(run, "candidate_id string, programmatic_pass boolean")
