"""Scoring settings: factors, presets and limits, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise


@dataclass(frozen=True)
class Factor:
    """bands: (raw value, sub-score) knots, raw value ascending. headline_km: the distance a summary speaks of."""

    name: str
    group: str
    unit: str
    bands: tuple[tuple[float, float], ...]
    headline_km: float | None = None

    def __post_init__(self) -> None:
        if self.group not in ("access", "momentum"):
            raise ValueError(f"{self.name}: unknown group {self.group}")
        if len(self.bands) < 2 or any(a[0] >= b[0] for a, b in pairwise(self.bands)):
            raise ValueError(f"{self.name}: knots must ascend")
        if any(not 0 <= y <= 100 for _, y in self.bands):
            raise ValueError(f"{self.name}: sub-scores run from 0 to 100")


@dataclass(frozen=True)
class Scoring:
    factors: tuple[Factor, ...]
    presets: dict[str, dict[str, float]]
    default: str
    confidence: float = 0.8
    max_drivers: int = 3
    driver_least: float = 50
    max_gaps: int = 2
    gap_most: float = 40
    best_area_people: int = 5000
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(f.name for f in self.factors))
        if self.default not in self.presets:
            raise ValueError("the default preset is missing")
        for preset, weights in self.presets.items():
            if set(weights) != set(self.names) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
                raise ValueError(f"{preset}: weights of 0 or more must cover all factors and sum to 1")


# Knots and weights of the published scoring model.
SCORING = Scoring(
    factors=(
        Factor("nh_access", "access", "km", ((0, 100), (2, 90), (5, 70), (10, 40), (25, 0)), 10),
        Factor("rail_access", "access", "km", ((0, 100), (1, 90), (3, 65), (8, 25), (15, 0)), 2),
        Factor("metro_access", "access", "km", ((0, 100), (1, 90), (2, 70), (5, 30), (10, 0)), 2),
        Factor("road_strength", "access", "km_per_km2", ((0, 0), (0.3, 30), (1, 65), (2, 90), (3, 100))),
        Factor("built_up_growth", "momentum", "pp", ((0, 0), (1, 30), (3, 60), (8, 90), (15, 100))),
    ),
    presets={
        "balanced": dict(nh_access=0.25, rail_access=0.15, metro_access=0.15, road_strength=0.15, built_up_growth=0.30),
        "commuter": dict(nh_access=0.10, rail_access=0.25, metro_access=0.30, road_strength=0.10, built_up_growth=0.25),
        "highway": dict(nh_access=0.45, rail_access=0.05, metro_access=0.00, road_strength=0.20, built_up_growth=0.30),
        "growth": dict(nh_access=0.15, rail_access=0.10, metro_access=0.10, road_strength=0.10, built_up_growth=0.55),
    },
    default="balanced",
)
# People from which a city is large or a metro.
METRO_PEOPLE, LARGE_PEOPLE = 2_500_000, 1_000_000
