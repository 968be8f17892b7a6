"""Settings of a generation run, and named recipes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .plans.planner import Ratios

TYPES = ("scratch", "stain", "discoloration", "crack", "pinhole", "dent")
FORMATS = ("coco", "yolo", "voc", "all")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, not {value}")


@dataclass(frozen=True)
class Config:
    """What to synthesise. `defect` is one of TYPES or `mixed`."""

    defect: str = "scratch"
    count: int = 100
    severity: float = 0.5
    frequency: float = 1.0
    lighting: float = 0.2
    texture: float = 0.1
    geometry: float = 0.2
    sensor: float = 0.0
    variability: float = 0.0
    defects_per_image: int = 1
    compound: bool = False
    auto_roi: bool = False
    round_robin: bool = False
    mixed_types: tuple[str, ...] = TYPES
    split: bool = True
    ratios: Ratios = field(default_factory=Ratios)
    random_seed: int = 42
    export: str = "coco"

    def __post_init__(self) -> None:
        if self.defect not in (*TYPES, "mixed"):
            raise ValueError(f"unknown defect {self.defect!r}; known: {', '.join(TYPES)}, mixed")
        if self.export not in FORMATS:
            raise ValueError(f"unknown format {self.export!r}; known: {', '.join(FORMATS)}")
        if not self.mixed_types or set(self.mixed_types) - set(TYPES):
            raise ValueError("mixed_types must name known defects")
        _within("count", self.count, 1, 2**62)
        _within("frequency", self.frequency, 0.1, 5)
        _within("defects_per_image", self.defects_per_image, 1, 5)
        for name in ("severity", "lighting", "texture", "geometry", "sensor", "variability"):
            _within(name, getattr(self, name), 0, 1)

    @property
    def passes(self) -> int:
        return self.defects_per_image if self.defects_per_image > 1 else 2 if self.compound else 1


@dataclass(frozen=True)
class Recipe:
    """A named bundle of settings; None leaves the setting to the caller."""

    name: str
    title: str = ""
    domain: str = ""
    settings: dict = field(default_factory=dict)

    def config(self, **given) -> Config:
        """The recipe's settings, overridden by those given (None is not given)."""
        known = {f.name for f in fields(Config)}
        unknown = set(self.settings) - known
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        merged = {k: tuple(v) if isinstance(v, list) else v for k, v in self.settings.items()}
        if isinstance(merged.get("ratios"), dict):
            merged["ratios"] = Ratios(**merged["ratios"])
        return replace(Config(**merged), **{k: v for k, v in given.items() if v is not None})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, default=list))

    @classmethod
    def load(cls, path: str | Path) -> "Recipe":
        data = json.loads(Path(path).read_text())
        if "name" not in data:
            raise ValueError("a recipe needs a name")
        return cls(**{k: v for k, v in data.items() if k in {f.name for f in fields(cls)}})


RECIPES = {
    r.name: r
    for r in (
        Recipe("metal", "Machined metal surfaces", "metal", {"defect": "scratch", "severity": 0.5, "lighting": 0.4, "texture": 0.15, "sensor": 0.2}),
        Recipe("ceramic", "Glazed ceramics", "ceramics", {"defect": "crack", "severity": 0.6, "lighting": 0.25, "texture": 0.05}),
        Recipe("textile", "Woven fabric", "textile", {"defect": "stain", "severity": 0.55, "geometry": 0.3, "texture": 0.25}),
        Recipe("plastic", "Moulded plastic", "plastics", {"defect": "discoloration", "severity": 0.4, "lighting": 0.3}),
        Recipe("coating", "Painted and coated panels", "automotive", {"defect": "pinhole", "frequency": 1.5, "sensor": 0.15}),
        Recipe("sheet", "Sheet-metal panels", "automotive", {"defect": "dent", "severity": 0.5, "lighting": 0.5}),
    )
}


def recipe(name: str) -> Recipe:
    found = RECIPES.get(name.strip().lower())
    if not found:
        raise KeyError(f"no recipe {name!r}; there are {', '.join(sorted(RECIPES))}")
    return found
