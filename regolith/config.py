"""Constants of the operators, passed explicitly: there is no global configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values, tuned for lunar orbital imagery."""

    moon_radius_m: float = 1737400.0
    contrast_kernel: int = 31
    confidence: float = 0.5
    tiles: int = 8
    tile_pad: int = 16
    min_tile_px: int = 128
    max_window_px: int = 1024
    refine_patch: int = 32
    refine_max_shift: float = 3.0
    ransac_px: float = 1.5
    complexity_margin: float = 0.15
    min_matches_for_split: int = 16
    uniformity_grid: int = 8
    noise_reject_ratio: float = 5.0
    control_roll_px: int = 15
    control_roll_tolerance_px: float = 4.0
    min_matches: int = 8
    hypotheses: int = 16
    most_hypotheses: int = 10_000
    certainty: float = 0.9999


DEFAULT = Config()
#: Degrees of freedom of the model classes, simplest first.
DOF = {"similarity": 4, "affine": 6, "homography": 8}
