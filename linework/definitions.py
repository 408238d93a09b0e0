"""Rows of definitions in short: paths, train groups and places of labels."""

from __future__ import annotations

from dataclasses import dataclass

# Kinds of train groups, and their usual numbers of cars.
KINDS = {"main": ("Stammzuggruppe", 4), "day": ("Tageszuggruppe", 4), "peak": ("HVZ-Verstärker", 2)}
# Directions of the corners of a mark at which names may stand.
CORNERS = {"top_right": (1, -1), "bottom_right": (1, 1), "bottom_left": (-1, 1)}


def ring_leg(group: str | None = None) -> dict:
    """An elastic path that gives way more than others, so that a ring can close."""
    return {"length": 2.0, "minimum": 0.3, "maximum": None, "flexibility": True, "flex": 2.0, "group": group}


def trains(kind: str, route: str, cars: int | None = None, **rest) -> dict:
    """A train group's fields; kind: main, day or peak."""
    name, usual = KINDS[kind]
    return {"kind": name, "route": route, "cars": usual if cars is None else cars, **rest}


@dataclass(frozen=True)
class Place:
    """Where a station's name goes: found, beside the track, in a direction, at a corner of the mark, or at fixed coordinates."""

    mode: str
    direction: tuple[float, float] | None = None
    corner: str | None = None
    shift: tuple[float, float] = (0.0, 0.0)
    align: str | None = None
    badge_order: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "beside", "toward", "corner", "fixed"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode == "toward" and self.direction is None:
            raise ValueError("toward asks for a direction")
        if self.mode == "corner":
            if self.corner not in CORNERS:
                raise ValueError(f"unknown corner {self.corner}")
            object.__setattr__(self, "direction", CORNERS[self.corner])
        if self.mode == "fixed":
            object.__setattr__(self, "direction", (1, -1))
