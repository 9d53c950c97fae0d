"""Named plugins: stages, clients, templates, formats; and callbacks on a run's events."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable
from enum import Enum
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame

log = logging.getLogger("quernstone")


class Stage(Protocol):
    """Changes a run's context. Registered with ``when``, it is left out where that says no to the context."""

    def __call__(self, context: Any) -> None: ...


class Critic(Protocol):
    """(sample_id, critic_model, issues, severity, passed) for samples."""

    def __call__(self, samples: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """(sample_id, scorer_model, ..., overall) for samples."""

    def __call__(self, samples: DataFrame) -> DataFrame: ...


class Template(Protocol):
    """A record format: its prompts, how a model's text is read, and which records are whole."""

    def system_prompt(self) -> str: ...
    def prompt(self, concept: Column, context: Column, difficulty: Column) -> Column: ...
    def parse(self, raw: Column, concept: Column, subtopic: Column, difficulty: Column) -> Column: ...
    def is_valid(self, record: Column) -> Column: ...


class Registry:
    """Names to objects. Registering another object under a name that is taken is an error."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str, item: Any = None) -> Any:
        """As a call with the object, or as a decorator without it."""
        if item is None:
            return lambda x: self.register(name, x)
        if self._items.get(name, item) is not item:
            raise ValueError(f"{self.kind} '{name}' is taken")
        self._items[name] = item
        return item

    def get(self, name: str) -> Any:
        if name not in self._items:
            raise KeyError(f"no {self.kind} '{name}'; there are: {', '.join(sorted(self._items)) or 'none'}")
        return self._items[name]

    def list_all(self) -> dict[str, Any]:
        return dict(self._items)

    def discover(self, group: str):
        """Registers the entry points of installed packages; those that fail to load are logged. Returns how many were added."""
        added = 0
        for point in entry_points(group=group):
            try:
                self.register(point.name, point.load())
                added += 1
            except Exception:
                log.exception("entry point %s of %s", point.name, group)
        return added

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def __len__(self) -> int:
        return len(self._items)


STAGES, CLIENTS, TEMPLATES, FORMATS = Registry("stage"), Registry("client"), Registry("template"), Registry("format")


class Event(str, Enum):
    PIPELINE_START = "pipeline_start"
    PIPELINE_END = "pipeline_end"
    STAGE_START = "stage_start"
    STAGE_END = "stage_end"
    ERROR = "error"
    SAMPLE_GENERATED = "sample_generated"
    BUDGET_WARNING = "budget_warning"


class Hooks:
    """Callbacks by event, called in the order of registration; what they raise is logged and goes no further."""

    def __init__(self):
        self._calls: dict[Event, list[Callable]] = defaultdict(list)

    def register(self, event: Event, call: Callable) -> None:
        self._calls[event].append(call)

    def unregister(self, event: Event, call: Callable) -> None:
        if call in self._calls[event]:
            self._calls[event].remove(call)

    def emit(self, event: Event, **about: Any) -> None:
        for call in list(self._calls[event]):
            try:
                call(**about)
            except Exception:
                log.exception("hook on %s", event.value)


def setup_logging(level: str = "INFO") -> logging.Logger:
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s %(message)s")
    log.setLevel(level)
    return log
