"""Settings of the command lines: an argument, else an environment variable, else a default."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, fields
from typing import Any

from tarnlight.schemas import CUTOFFS, PASSAGES

#: Settings that the environment may give, unless an argument does.
VARIABLES = {"encoder": "TARNLIGHT_ENCODER", "encoder_model": "TARNLIGHT_ENCODER_MODEL", "generator": "TARNLIGHT_GENERATOR", "generator_model": "TARNLIGHT_GENERATOR_MODEL", "index_folder": "TARNLIGHT_INDEXES"}


@dataclass(frozen=True)
class Settings:
    """What a run reads, which parts it is put together from, and where its table goes."""

    source: str = ""  # folder of a collection, or file of a haystack
    needles: str = ""
    split: str = "test"
    retrievers: tuple[str, ...] = ("bm25", "dense")
    cutoffs: tuple[int, ...] = CUTOFFS
    passages: int = PASSAGES
    encoder: str = "hash"
    encoder_model: str | None = None
    generator: str = "echo"
    generator_model: str | None = None
    max_new_tokens: int = 256
    temperature: float = 0.0
    top_p: float = 1.0
    index_folder: str | None = None
    out: str | None = None


def resolve(name: str, given: Any = None) -> Any:
    """The value of a setting; an empty one falls through to the next place."""
    default = next(f.default for f in fields(Settings) if f.name == name)
    return given or os.environ.get(VARIABLES.get(name, "")) or default


def parse(description: str, names: list[str], argv: list[str] | None = None) -> Settings:
    """Settings from a command line that takes ``names``."""
    p = argparse.ArgumentParser(description=description)
    kinds = {f.name: f for f in fields(Settings)}
    for name in names:
        default = kinds[name].default
        many = {"nargs": "+"} if isinstance(default, tuple) else {}
        kind = type(default[0]) if isinstance(default, tuple) else type(default) if default is not None else str
        p.add_argument(f"--{name.replace('_', '-')}", type=kind, default=None, required=name in ("source", "needles"), **many)
    got = vars(p.parse_args(argv))
    read = {k: tuple(v) if isinstance(v, list) else v for k, v in got.items()}
    return Settings(**{k: v if v is not None and v != "" else resolve(k) for k, v in read.items()}, **{k: resolve(k) for k in VARIABLES if k not in read})
