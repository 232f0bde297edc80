"""Tunable values of the analysis, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Analysis:
    """Matching, candidates and verification."""

    ratio: float = 0.8
    mutual: bool = True
    learned_threshold: float = 0.1
    affinity_descriptors: int = 512
    proposal_neighbours: int = 2
    bridge_pairs: int = 2
    bridge_rounds: int = 3
    inlier_threshold: float = 3.0  # pixels at one megapixel
    max_iterations: int = 5000
    confidence: float = 0.999
    seed: int = 1
    minimum_features: int = 50
    minimum_inliers: int = 15
    minimum_coverage: float = 0.05
    minimum_hull_fraction: float = 0.005
    simpler_share: float = 0.92
    match_cap: int = 300
    grid: int = 8
    overlap_per_photo: int = 6


@dataclass(frozen=True)
class Stitching:
    """Rendering of a layout."""

    projection: str = "automatic"  # or rectilinear, cylindrical, spherical: for turned cameras
    blending: str = "multiband"  # or hard, none
    exposure: str = "gain"  # or channels, blocks, none
    seams: str = "voronoi"  # or path
    crop: bool = False


DEFAULTS = Analysis()
MODELS = {"translation": 2, "similarity": 4, "affine": 6, "homography": 8, "rotation": 3}
MODES = {
    "automatic": ("translation", "similarity", "affine", "homography"),
    "plane": ("translation", "similarity", "affine"),
    "document": ("translation", "similarity", "affine", "homography"),
    "rotation": ("homography",),
}
