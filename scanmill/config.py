"""Sensor rigs and raster parameters.

These are configuration, not data: a rig has a handful of mounts however many
frames it recorded, so the values travel through plans as literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from math import floor


@dataclass(frozen=True)
class Bev:
    """Bird's-eye-view plane: cell counts, cell size in metres, z range."""

    x_size: int = 1024
    y_size: int = 1024
    voxel_size: float = 0.1
    padding: float = 3.7
    z_min: float = -1.0
    z_max: float = 2.0


@dataclass(frozen=True)
class SensorMount:
    name: str
    x: float
    y: float
    z: float
    yaw_deg: float


@dataclass(frozen=True)
class SensorModel:
    """A virtual sensor and the mounts that carry it.

    ``azimuth_steps`` spreads that many equal steps over the field of view;
    ``azimuth_bands`` lists ``(first, last, step)`` instead and wins when given.
    """

    name: str
    mounts: tuple[SensorMount, ...]
    distance: float
    fov_min: float
    fov_max: float
    elevations_deg: tuple[float, ...]
    azimuth_steps: int = 0
    azimuth_bands: tuple[tuple[float, float, float], ...] = ()

    @property
    def half_fov(self) -> float:
        """Half the opening angle; a range that crosses the wrap gets a full turn."""
        half = (self.fov_max - self.fov_min) / 2
        return half + 360 if half < 0 else half

    @property
    def azimuth_count(self) -> int:
        if self.azimuth_bands:
            return sum(floor((last - first) / step + 1e-6) + 1 for first, last, step in self.azimuth_bands)
        return self.azimuth_steps + 1

    @property
    def rays_per_mount(self) -> int:
        return self.azimuth_count * len(self.elevations_deg)

    @property
    def ray_count(self) -> int:
        return self.rays_per_mount * len(self.mounts)

    def select(self, names: Iterable[str] | None) -> SensorModel:
        """Keep the named mounts in rig order; ``None`` keeps them all."""
        if names is None:
            return self
        wanted = set(names)
        return replace(self, mounts=tuple(m for m in self.mounts if m.name in wanted))


# Mounts (x, y, z in metres, yaw in degrees), fields of view and beam angles.
MODELS: dict[str, SensorModel] = {
    "scala": SensorModel(
        name="scala",
        mounts=(
            SensorMount("front_left", 3.255, 0.885, 0.535, 66.0),
            SensorMount("front_center", 3.61, -0.154, 0.338, 0.0),
            SensorMount("front_right", 3.255, -0.885, 0.535, -66.0),
            SensorMount("rear_left", -0.825, 0.8, 0.345, -248.0),
            SensorMount("rear_center", -1.045, 0.0, 0.345, 180.0),
            SensorMount("rear_right", -0.825, -0.8, 0.345, 248.0),
        ),
        distance=80.0,
        fov_min=-72.5,
        fov_max=72.5,
        elevations_deg=(-0.4, 0.4, 1.2),
        azimuth_steps=580,
    ),
    "scala2": SensorModel(
        name="scala2",
        mounts=(
            SensorMount("front_left", 3.850, 0.8, 0.353, 46.0),
            SensorMount("front_center", 4.105, 0.0, 0.235, 0.0),
            SensorMount("front_right", 3.860, -0.810, 0.350, -46.0),
            SensorMount("rear_left", -0.675, 0.985, 0.423, -270.0),
            SensorMount("rear_center", -1.065, 0.0, 0.33, 180.0),
            SensorMount("rear_right", -0.680, -0.982, 0.421, 271.0),
        ),
        distance=100.0,
        fov_min=-66.5,
        fov_max=66.5,
        elevations_deg=(
            -4.749, -4.1465, -3.5440, -2.9415, -2.1850, -1.5825, -0.9800, -0.3775,
            0.3790, 0.9815, 1.5840, 2.1865, 2.9430, 3.5455, 4.1480, 4.7505,
        ),
        azimuth_bands=((-66.5, -15.25, 0.25), (-15.0, 15.0, 0.125), (15.25, 66.5, 0.25)),
    ),
}

BEV = Bev()

# Box type codes kept, their class names and class numbers, drawing colours.
BOX_TYPES = (1, 2, 4)
CLASS_NAMES = {1: "Vehicle", 2: "Pedestrian", 4: "Cyclist"}
OTHER_CLASS = "Unknown"
CLASS_IDS = {"Vehicle": 0, "Pedestrian": 1, "Cyclist": 2}
BOX_COLOURS = {1: (0.0, 1.0, 0.0), 2: (0.0, 0.0, 1.0), 4: (0.0, 0.5, 0.5)}

# Sensor folder names, split list names and split folder names.
SENSOR_NAMES = ("front_left", "front_center", "front_right", "rear_left", "rear_center", "rear_right")
SPLIT_FOLDERS = {"train": "training", "val": "validation", "test": "testing"}


def sensor_model(name: str, selected: Iterable[str] | None = None) -> SensorModel:
    if name not in MODELS:
        raise ValueError(f"unknown sensor model {name!r}; known models: {sorted(MODELS)}")
    return MODELS[name].select(selected)
