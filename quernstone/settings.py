"""Settings: defaults, then a TOML file, then a .env file, then environment variables, each over the one before."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from quernstone.functions.web import BLOCKED
from quernstone.operators.clean import CleanSettings

PREFIX = "QUERNSTONE_"


@dataclass(frozen=True)
class CollectSettings:
    blocked_domains: list[str] = field(default_factory=lambda: list(BLOCKED))
    max_documents: int = 20
    max_pages: int = 50
    min_content_length: int = 200
    min_word_count: int = 100
    requests_per_second: float = 2.0


@dataclass(frozen=True)
class GenerateSettings:
    batch_size: int = 10
    default_format: str = "reasoning"
    max_concurrent: int = 2
    max_samples: int = 100
    self_consistency_models: list[str] = field(default_factory=list)
    self_consistency_n: int = 1
    temperature: float = 0.7


@dataclass(frozen=True)
class VerifySettings:
    critic_model: str = ""
    enabled: bool = True
    judge_models: list[str] = field(default_factory=list)
    min_pass_rate: float = 0.6
    min_score: float = 0.7
    programmatic_check: bool = True
    scorer_model: str = ""


@dataclass(frozen=True)
class RefineSettings:
    max_retries: int = 2


@dataclass(frozen=True)
class BudgetSettings:
    max_cost_usd: float | None = None
    warn_at_percent: float = 80.0


@dataclass(frozen=True)
class GateSettings:
    max_duplicate_rate: float = 0.10
    min_diversity_score: float = 0.5
    min_verification_score: float = 0.6


@dataclass(frozen=True)
class Settings:
    output_dir: str = "./output"
    default_provider: str = "table"
    default_model: str = ""
    log_level: str = "INFO"
    collect: CollectSettings = field(default_factory=CollectSettings)
    clean: CleanSettings = field(default_factory=CleanSettings)
    generate: GenerateSettings = field(default_factory=GenerateSettings)
    verify: VerifySettings = field(default_factory=VerifySettings)
    refine: RefineSettings = field(default_factory=RefineSettings)
    budget: BudgetSettings = field(default_factory=BudgetSettings)
    quality_gates: GateSettings = field(default_factory=GateSettings)


def _typed(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()]
    if like is None:
        return float(text) if text.strip() else None
    return type(like)(text)


def _env(named: dict[str, str], settings: Settings) -> Settings:
    for f in fields(settings):
        own = getattr(settings, f.name)
        if hasattr(own, "__dataclass_fields__"):
            part = {g.name: _typed(named[k], getattr(own, g.name)) for g in fields(own) if (k := f"{PREFIX}{f.name}__{g.name}".upper()) in named}
            settings = replace(settings, **{f.name: replace(own, **part)})
        elif (k := f"{PREFIX}{f.name}".upper()) in named:
            settings = replace(settings, **{f.name: _typed(named[k], own)})
    return settings


def load(toml: str | None = None, env_file: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Names in the environment are like QUERNSTONE_GENERATE__MAX_SAMPLES. Unknown names in files are left out."""
    settings = Settings()
    if toml and os.path.exists(toml):
        with open(toml, "rb") as f:
            data = tomllib.load(f)
        for f in fields(settings):
            if f.name in data:
                own = getattr(settings, f.name)
                if isinstance(data[f.name], dict) and hasattr(own, "__dataclass_fields__"):
                    own = replace(own, **{k: v for k, v in data[f.name].items() if k in own.__dataclass_fields__})
                    settings = replace(settings, **{f.name: own})
                else:
                    settings = replace(settings, **{f.name: data[f.name]})
    if env_file and os.path.exists(env_file):
        with open(env_file) as f:
            pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
        settings = _env({k.strip().upper(): v.strip().strip("\"'") for k, v in pairs}, settings)
    return _env({k.upper(): v for k, v in (os.environ if environ is None else environ).items()}, settings)
