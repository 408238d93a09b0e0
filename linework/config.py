"""Parameters of layout and drawing; defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    default_start: int = 45
    min_gap: float = 0.2
    spacing: float = 1.2
    radius_45: float = 0.8
    radius_90: float = 1.2
    radius_135: float = 0.4
    component_gap: float = 40.0
    regularisation: float = 1e-10
    residual: float = 1e-7
    bound_slack: float = 1e-8
    reconstruction: float = 1e-6
    agreement: float = 1e-9


@dataclass(frozen=True)
class Projection:
    """GRS80 and the window's centre in degrees."""

    a: float = 6378137.0
    f: float = 1 / 298.257222101
    lon0: float = 13.45455
    lat0: float = 52.52542

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def ep2(self) -> float:
        return self.e2 / (1 - self.e2)


LAYOUT, PROJECTION = Layout(), Projection()
