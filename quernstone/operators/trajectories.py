"""Agent trajectories: steps to records, ReAct and tool-call dialogues, terminal output.

Steps are rows (traj_id, task, pos, observation, thought, tool, input, result); input is JSON text.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_OUTPUT, MAX_PAGE = 10_000, 5000
_MARK = "\n... (truncated)"


def record(steps: DataFrame, outcome: str = "success") -> DataFrame:
    """(traj_id, task, steps, outcome): each trajectory's steps in order."""
    action = F.struct("tool", "input")
    step = F.struct("pos", "observation", "thought", action.alias("action"), "result")
    return steps.groupBy("traj_id").agg(F.min("task").alias("task"), F.array_sort(F.collect_list(step)).alias("steps")).withColumn("outcome", F.lit(outcome))


def _system(task: Column) -> Column:
    return F.concat(F.lit("You are an agent solving: "), task)


def to_react(trajectories: DataFrame) -> DataFrame:
    """(traj_id, messages): system, then for each step an observation and a thought with action and result."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))

    def turns(s: Column) -> Column:
        act = F.concat(F.lit("Thought: "), s["thought"], F.lit("\nAction: "), s["action"]["tool"], F.lit("("), s["action"]["input"], F.lit(")\nResult: "), s["result"])
        return F.array(say("user", F.concat(F.lit("Observation: "), s["observation"])), say("assistant", act))

    return trajectories.select("traj_id", F.concat(F.array(say("system", _system(F.col("task")))), F.flatten(F.transform("steps", turns))).alias("messages"))


def to_chatml(trajectories: DataFrame) -> DataFrame:
    """(traj_id, messages): tool calls and their results as messages of their own; fields that a message lacks are null."""
    call_type = "array<struct<type: string, function: struct<name: string, arguments: string>>>"
    none = F.lit(None)

    def say(role: str, text: Column, name: Column = none, calls: Column = none) -> Column:
        return F.struct(F.lit(role).alias("role"), name.cast("string").alias("name"), text.alias("content"), calls.cast(call_type).alias("tool_calls"))

    def turns(s: Column) -> Column:
        call = F.array(F.struct(F.lit("function").alias("type"), F.struct(s["action"]["tool"].alias("name"), s["action"]["input"].alias("arguments")).alias("function")))
        return F.array(say("user", s["observation"]), say("assistant", s["thought"], calls=call), say("tool", s["result"], s["action"]["tool"]))

    return trajectories.select("traj_id", F.concat(F.array(say("system", _system(F.col("task")))), F.flatten(F.transform("steps", turns))).alias("messages"))


def messages_json(formatted: DataFrame) -> DataFrame:
    """(traj_id, record): {"messages": [...]} without the fields that are null."""
    return formatted.select("traj_id", F.to_json(F.struct("messages")).alias("record"))


def truncated(output: Column, most: int = MAX_OUTPUT) -> Column:
    return F.when(F.length(output) > most, F.concat(F.substring(output, 1, most), F.lit(_MARK))).otherwise(output)


def run_command(command: str, timeout: float = 30, allow: bool = False) -> str:
    """Output and errors of a shell command, cut as ``truncated`` does. Off unless allowed: it runs what it is given."""
    if not allow:
        raise PermissionError("running commands is off; pass allow=True")
    try:
        done = subprocess.run(command, shell=True, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return f"timed out after {timeout} s"
    out = done.stdout + ("\n" + done.stderr if done.stderr else "")
    return out if len(out) <= MAX_OUTPUT else out[:MAX_OUTPUT] + _MARK


def browse(url: str) -> str:
    """No browser is bundled; a pluggable client returns page text, of which ``MAX_PAGE`` characters are kept."""
    return f"[no browser: {url}]"[:MAX_PAGE]
