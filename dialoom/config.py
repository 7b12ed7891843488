"""Settings of the engine: frozen dataclasses with validators that list every problem at once."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .errors import ConfigurationError

# Openers of narration that usually start a new scene.
TRANSITIONS = (
    r"^(?:(?:later|earlier) that (?:day|night|evening|afternoon|morning|week)\b"
    r"|later on\b|meanwhile\b"
    r"|that (?:same )?(?:day|night|evening|afternoon|morning|weekend)\b"
    r"|the (?:next|following) (?:day|night|morning|evening|afternoon|week|weekend)\b"
    r"|next (?:morning|day|night|evening|week)\b"
    r"|(?:a|one|two|three|four|five|a few|several) (?:hours?|days?|weeks?|months?) later\b"
    r"|across town\b"
    r"|(?:on )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday) "
    r"(?:morning|afternoon|evening|night)\b)"
)


@dataclass(frozen=True)
class Chunking:
    size: int = 512
    overlap: int = 64
    settings: tuple[tuple[int, int], ...] = ((256, 32), (512, 64), (1024, 128))
    context: int = 8192
    special_tokens: int = 2

    def problems(self) -> list[str]:
        out = [] if self.settings else ["chunking.settings is empty"]
        for size, overlap in self.settings:
            if size < 1:
                out.append(f"chunk size {size} is not positive")
            if not 0 <= overlap < max(size, 1):
                out.append(f"overlap {overlap} is not in 0..size-1 of size {size}")
            if size + self.special_tokens > self.context:
                out.append(f"size {size} does not fit into a context of {self.context}")
        if len({s for s, _ in self.settings}) < len(self.settings):
            out.append("two chunk settings have the same size")
        if (self.size, self.overlap) not in self.settings:
            out.append("the default chunk setting is not in the list")
        return out


@dataclass(frozen=True)
class Scenes:
    enabled: bool = True
    window: int = 6
    max_similarity: float = 0.25
    min_lines: int = 6
    transitions: str = TRANSITIONS

    def problems(self) -> list[str]:
        out = []
        if min(self.window, self.min_lines) < 1:
            out.append("scenes.window and scenes.min_lines start at 1")
        if not 0 <= self.max_similarity <= 1:
            out.append("scenes.max_similarity is a share")
        try:
            re.compile(self.transitions)
        except re.error as e:
            out.append(f"scenes.transitions: {e}")
        return out


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.0
    rrf_k: int = 60
    candidates: int = 30
    k: int = 8

    def problems(self) -> list[str]:
        out = [] if self.k1 > 0 else ["retrieval.k1 must be positive"]
        out += [] if 0 <= self.b <= 1 else ["retrieval.b is a share"]
        out += [] if self.epsilon >= 0 else ["retrieval.epsilon must not be negative"]
        return out + [f"retrieval.{n} starts at 1" for n in ("rrf_k", "candidates", "k") if getattr(self, n) < 1]


@dataclass(frozen=True)
class Evaluation:
    ks: tuple[int, ...] = (1, 5, 10)
    all_ks: tuple[int, ...] = (5, 10)
    compare_k: int = 5
    depth: int = 50
    seed: int = 20261001
    dev_size: int = 20
    candidates: int = 20000

    def problems(self) -> list[str]:
        out = []
        if not self.ks or min(self.ks) < 1 or list(self.ks) != sorted(set(self.ks)):
            return ["evaluation.ks must be positive and increasing"]
        if not set(self.all_ks) <= set(self.ks):
            out.append("evaluation.all_ks must be among ks")
        if self.compare_k not in self.ks:
            out.append("evaluation.compare_k must be among ks")
        if self.depth < max(self.ks):
            out.append("evaluation.depth is less than the largest k")
        if min(self.dev_size, self.candidates) < 1:
            out.append("evaluation.dev_size and candidates start at 1")
        return out


@dataclass(frozen=True)
class Corpus:
    keep_label_on_first: bool = False
    unknown_speaker: str = "(unknown)"

    def problems(self) -> list[str]:
        return [] if self.unknown_speaker.strip() else ["corpus.unknown_speaker is blank"]


@dataclass(frozen=True)
class Settings:
    corpus: Corpus = field(default_factory=Corpus)
    chunking: Chunking = field(default_factory=Chunking)
    scenes: Scenes = field(default_factory=Scenes)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def problems(self) -> list[str]:
        return [p for f in fields(self) for p in getattr(self, f.name).problems()]

    def validate(self) -> Settings:
        if found := self.problems():
            raise ConfigurationError("invalid settings", actual="; ".join(found))
        return self

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def load_settings(path: str | Path | None = None) -> Settings:
    """Defaults, overridden by a TOML file with one table for each section; unknown keys are errors."""
    settings = Settings()
    if path is None:
        return settings.validate()
    wanted = tomllib.loads(Path(path).read_text("utf-8"))
    for section, values in wanted.items():
        if not hasattr(settings, section) or not isinstance(values, dict):
            raise ConfigurationError("unknown section", actual=section)
        own = getattr(settings, section)
        for key, value in values.items():
            if key not in {f.name for f in fields(own)}:
                raise ConfigurationError("unknown key", actual=f"{section}.{key}")
            default = getattr(own, key)
            if isinstance(default, tuple):
                value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
            elif isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if type(value) is not type(default):
                raise ConfigurationError("wrong type", expected=type(default).__name__, actual=f"{section}.{key} = {value!r}")
            own = replace(own, **{key: value})
        settings = replace(settings, **{section: own})
    return settings.validate()
