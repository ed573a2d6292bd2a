"""Canonical tables. Every operator keys on frame, so one job answers for all frames."""

from __future__ import annotations

from dataclasses import dataclass

FRAMES = "frame int, timestep bigint, n_atoms int, has_box boolean, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, per_x boolean, per_y boolean, per_z boolean, tilt_xy double, tilt_xz double, tilt_yz double"
ATOMS = "frame int, atom int, id bigint, element string, x double, y double, z double, charge double, columns map<string,float>, labels map<string,string>"
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """A cell shared by all frames; lengths are never negative. Tilts are kept, but images are those of the orthogonal cell.

    Where frames have cells of their own, operators.boxes.FrameBoxes takes its place.
    """

    lo: tuple[float, float, float]
    hi: tuple[float, float, float]
    periodic: tuple[bool, bool, bool] = (True, True, True)
    tilt: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def lengths(self) -> tuple[float, float, float]:
        return tuple(max(0.0, h - l) for l, h in zip(self.lo, self.hi, strict=True))  # type: ignore[return-value]  # noqa: E741

    @property
    def centre(self) -> tuple[float, float, float]:
        return tuple((l + h) / 2 for l, h in zip(self.lo, self.hi, strict=True))  # type: ignore[return-value]  # noqa: E741

    @property
    def volume(self) -> float:
        a, b, c = self.lengths
        return a * b * c

    @property
    def tilted(self) -> bool:
        return any(t != 0 for t in self.tilt)

    def shortest(self) -> float | None:
        return min((v for v in self.lengths if v > 0), default=None)
