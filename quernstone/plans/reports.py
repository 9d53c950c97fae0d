"""A run's metrics as JSON, HTML and text."""

from __future__ import annotations

import json
from html import escape


def json_report(metrics: dict) -> str:
    return json.dumps(metrics, indent=2, default=str, sort_keys=True)


def html_report(metrics: dict, title: str = "Dataset report") -> str:
    """A table with a row for each top-level field."""
    rows = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(json.dumps(v, default=str))}</td></tr>" for k, v in metrics.items())
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{rows}</table></body></html>"


def console_summary(metrics: dict) -> str:
    width = max(map(len, map(str, metrics)), default=0)
    return "\n".join(f"{k!s:<{width}}  {v}" for k, v in metrics.items())
