"""Parameters of an inventory, by the step that they belong to. Lengths are metres, angles degrees."""

from __future__ import annotations

from dataclasses import dataclass, field

# Codes of a section's state. Codes of 0 and above have a fitted circle.
NOT_COMPUTED, NOT_ENOUGH_POINTS, SUCCESS, TILT_OUTLIER, TOO_SMALL, TOO_LARGE, INNER_POINTS, FEW_SECTORS = -2, -1, 0, 1, 2, 3, 4, 5

# Codes of where a diameter at breast height comes from.
SOURCE_NONE, SOURCE_SECTION, SOURCE_SUPPORTED, SOURCE_PAIR, SOURCE_NEAREST = -1, 0, 1, 2, 3

# Codes of how a run ended.
RUN_SUCCESS, RUN_INVALID, RUN_TERRAIN_TOO_SMALL, RUN_NO_CLUSTERS = 0, 1, 2, 3

NO_CLUSTER = -1


@dataclass(frozen=True)
class Ground:
    cloth_resolution: float = 0.45
    denoise: bool = False
    denoise_resolution: float = 0.15
    denoise_minimum_points: int = 2
    smooth_lambda: float = 0.125
    smooth_sweeps: int = 20
    clean: bool = True


@dataclass(frozen=True)
class Peel:
    """A height band and how its vertical clusters are peeled."""

    lower: float = 0.7
    upper: float = 3.5
    verticality_scale: float = 0.1
    verticality_threshold: float = 0.7
    voxels_threshold: int = 1000
    resolution_xy: float = 0.02
    resolution_z: float = 0.02
    iterations: int = 2


@dataclass(frozen=True)
class Tree:
    resolution_xy: float = 0.035
    resolution_z: float = 0.035
    height_range: float = 0.7
    maximum_dist_axis: float = 15.0
    minimum_points_stem: int = 20
    maximum_deviation: float = 25.0
    height_distance_from_axis: float = 1.5
    resolution_height: float = 0.3


@dataclass(frozen=True)
class Stem:
    search_diameter: float = 2.0
    minimum_height: float = 0.3
    maximum_height: float = 25.0
    verticality_radius: float = 0.1
    verticality_threshold: float = 0.7
    thickness: float = 0.05
    circle_width: float = 0.02
    interval: float = 0.2
    clustering_distance: float = 0.02
    minimum_diameter: float = 0.09
    maximum_diameter: float = 1.0
    inner_point_threshold: int = 5
    minimum_points: int = 80
    diameter_proportion: float = 0.5
    sector_count: int = 16
    minimum_sectors: int = 9
    outlier_probability: float = 0.3
    breast_height: float = 1.3

    @property
    def sections(self) -> int:
        return int((self.maximum_height - self.minimum_height) / self.interval)

    def section_start(self, i: int) -> float:
        return self.minimum_height + i * self.interval

    @property
    def breast_section(self) -> int:
        """The section whose start is nearest to breast height, the first of equally near ones."""
        return min(range(max(1, self.sections)), key=lambda i: (abs(self.section_start(i) - self.breast_height), i))


@dataclass(frozen=True)
class Draw:
    circle_points: int = 200
    axis_interval: float = 0.01


@dataclass(frozen=True)
class Georeference:
    """Local coordinates are (global + shift) * scale."""

    shift_x: float = 0.0
    shift_y: float = 0.0
    shift_z: float = 0.0
    scale: float = 1.0


@dataclass(frozen=True)
class Params:
    ground: Ground = field(default_factory=Ground)
    stripe: Peel = field(default_factory=Peel)
    tree: Tree = field(default_factory=Tree)
    stem: Stem = field(default_factory=Stem)
    draw: Draw = field(default_factory=Draw)
    georeference: Georeference = field(default_factory=Georeference)
    normalise_heights: bool = True

    def stem_peel(self) -> Peel:
        """The second peel: the stem's height band, its own verticality, otherwise like the stripe's."""
        s = self.stem
        return Peel(
            lower=s.minimum_height,
            upper=s.maximum_height + s.thickness,
            verticality_scale=s.verticality_radius,
            verticality_threshold=s.verticality_threshold,
            voxels_threshold=self.stripe.voxels_threshold,
            resolution_xy=self.stripe.resolution_xy,
            resolution_z=self.stripe.resolution_z,
            iterations=self.stripe.iterations,
        )
