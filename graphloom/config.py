"""Settings: defaults, a file, drop-ins beside it, the environment and flags, each over the ones before."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Server:
    bind: str = "127.0.0.1:7878"
    data: list[str] = field(default_factory=list)
    materialise: bool = False
    default_graph: str = "union"


@dataclass
class Limits:
    """0 is no limit."""

    query_timeout_s: int = 0
    max_result_rows: int = 0


@dataclass
class Spark:
    master: str = ""
    shuffle_partitions: int = 0
    checkpoint_dir: str = ""


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    limits: Limits = field(default_factory=Limits)
    spark: Spark = field(default_factory=Spark)


PREFIX = "GRAPHLOOM_"


def _put(target: object, key: str, value: object, where: str) -> None:
    known = {f.name for f in fields(target)}
    if key not in known:
        raise ValueError(f"{where}: unknown setting {key}")
    now = getattr(target, key)
    if is_dataclass(now):
        if not isinstance(value, Mapping):
            raise ValueError(f"{where}: {key} is a section")
        for k, v in value.items():
            _put(now, k, v, where)
        return
    if isinstance(value, str) and not isinstance(now, str):
        value = value.lower() in ("1", "true", "yes") if isinstance(now, bool) else int(value) if isinstance(now, int) else value.split(",")
    if isinstance(value, bool) != isinstance(now, bool) or type(value) is not type(now):
        raise ValueError(f"{where}: {key} takes a {type(now).__name__}")
    setattr(target, key, value)


def load(path: str | None = None, env: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> Config:
    """Files are TOML; drop-ins are ``path.d/*.toml`` by name; ``GRAPHLOOM_SERVER_BIND`` sets ``server.bind``; flags are ``section.key``."""
    config = Config()
    files = [Path(path), *sorted(Path(f"{path}.d").glob("*.toml"))] if path else []
    for file in files:
        with file.open("rb") as f:
            for key, value in tomllib.load(f).items():
                _put(config, key, value, str(file))
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(PREFIX):
            section, _, key = name[len(PREFIX) :].lower().partition("_")
            _put(config, section, {key: value}, name)
    for name, value in (flags or {}).items():
        section, _, key = name.partition(".")
        _put(config, section, {key: value}, f"flag {name}")
    if config.server.default_graph not in ("union", "strict"):
        raise ValueError("server.default_graph is union or strict")
    return config
