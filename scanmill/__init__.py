"""scanmill: sparse driving-LiDAR training sets as Spark DataFrame jobs."""

from scanmill.config import BEV, MODELS, Bev, SensorModel, SensorMount, sensor_model
from scanmill.plans.dataset import build_dataset, to_obb_samples, write_dataset
from scanmill.sources.runs import compact, read_output

__all__ = [
    "BEV",
    "MODELS",
    "Bev",
    "SensorModel",
    "SensorMount",
    "build_dataset",
    "compact",
    "read_output",
    "sensor_model",
    "to_obb_samples",
    "write_dataset",
]
