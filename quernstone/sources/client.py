"""Model clients: prompts to texts, on executors, with retries, cost and a bounded number of calls at a time.

A client is anything with ``complete(prompt, system, model) -> dict`` with text, tokens_in, tokens_out and, if known, cost.
It is pickled to executors, so it holds no secrets: it reads them from the environment there.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.shared import checkpointed


class Client(Protocol):
    def complete(self, prompt: str, system: str, model: str) -> dict[str, Any]: ...


class RateLimited(RuntimeError):
    """A client raises this to be asked again later."""


def call(client: Client, prompt: str, system: str, model: str, attempts: int = 5, wait: float = 2.0) -> dict[str, Any]:
    """One call; after a rate limit it waits wait * 2^k seconds and asks again. The price is estimated where the client has none."""
    for k in range(attempts):
        try:
            got = dict(client.complete(prompt, system, model))
            break
        except RateLimited:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    n_in, n_out = int(got.get("tokens_in") or max(1, len(prompt) // 4)), int(got.get("tokens_out") or max(1, len(got["text"]) // 4))
    cost = got.get("cost")
    return {"text": got["text"], "model": model, "tokens_in": n_in, "tokens_out": n_out, "cost": float(cost) if cost is not None else n_in / 1000 * 0.01 + n_out / 1000 * 0.03}


def unfenced(text: str) -> str:
    t = text.strip()
    if t.startswith("```") and "\n" in t:
        t = t.split("\n", 1)[1].rpartition("```")[0].strip() or t.split("\n", 1)[1].strip()
    return t


def complete_structured(client: Client, prompt: str, schema: dict, system: str = "", model: str = "", attempts: int = 3) -> dict:
    """A JSON object with the schema's required keys; asks again when it gets none, ValueError in the end."""
    for _ in range(attempts):
        try:
            value = json.loads(unfenced(call(client, f"{prompt}\nAnswer with JSON for this schema:\n{json.dumps(schema)}", system, model)["text"]))
        except ValueError:
            continue
        if isinstance(value, dict) and all(k in value for k in schema.get("required", [])):
            return value
    raise ValueError(f"no usable JSON in {attempts} attempts")


SCHEMA = "call_id string, text string, model string, tokens_in long, tokens_out long, cost double, error string"


def complete_batch(prompts: DataFrame, client: Client, model: str = "", concurrency: int = 2, stage: str = "") -> DataFrame:
    """(call_id, text, model, tokens_in, tokens_out, cost, error, stage) for prompts (call_id, prompt, system).

    Partitions bound how many calls run at a time. The result is checkpointed: a call costs money and must not run twice.
    A failed call has an error and no text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, prompt, system in zip(f["call_id"], f["prompt"], f["system"]):
                try:
                    rows.append({"call_id": i, **call(client, prompt, system or "", model), "error": None})
                except Exception as e:
                    rows.append({"call_id": i, "text": None, "model": model, "tokens_in": 0, "tokens_out": 0, "cost": 0.0, "error": str(e)})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    sent = prompts.select(F.col("call_id").cast("string").alias("call_id"), "prompt", "system").repartition(max(1, concurrency))
    return checkpointed(sent.mapInPandas(run, SCHEMA)).withColumn("stage", F.lit(stage))


def from_table(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Offline: texts that are there already, (call_id, model, text, ...), for the prompts."""
    return prompts.select("call_id").join(responses, "call_id", "left")


def resolve_model(model: str | None, default: str) -> str:
    return model or default


def push_credentials(secrets: dict[str, str]) -> list[str]:
    """Sets environment variables for secrets that aren't empty; returns their names only."""
    named = [k for k, v in secrets.items() if v]
    os.environ.update({k: secrets[k] for k in named})
    return named


class Echo:
    """A client for tests: answers from a function of the prompt."""

    def __init__(self, answer=lambda prompt: prompt):
        self.answer = answer

    def complete(self, prompt: str, system: str, model: str) -> dict[str, Any]:
        return {"text": self.answer(prompt)}
