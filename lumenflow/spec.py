"""Operator registry: every operator states its type id, parameters with defaults and outputs, and how it plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class FlowError(ValueError):
    """A flow or parameter that cannot be planned."""


@dataclass(frozen=True)
class Operator:
    type_id: str
    family: str
    params: dict[str, Any]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    plan: Callable[..., DataFrame] = field(repr=False)
    #: For image to image operators: the function of one frame, so that chains run in one pass.
    kernel: Callable | None = field(default=None, repr=False)

    def bind(self, given: dict[str, Any] | None = None) -> dict[str, Any]:
        """Declared defaults overlaid by what is given; unknown names are an error, null means the default."""
        names = SYNONYMS.get(self.type_id, {})
        given = {names.get(k, k): v for k, v in (given or {}).items() if v is not None}
        if unknown := set(given) - set(self.params):
            raise FlowError(f"{self.type_id} has no parameter {', '.join(sorted(unknown))}")
        bound = dict(self.params)
        for k, v in given.items():
            want = self.params[k]
            if isinstance(want, bool) != isinstance(v, bool) or isinstance(want, str) != isinstance(v, str):
                continue  # a value of another type falls back to the default
            bound[k] = v
        return bound


#: Other names of parameters, by operator.
SYNONYMS: dict[str, dict[str, str]] = {
    "DistancePointEllipse": {"a": "ea", "b": "eb"},
    "PrecisionReport": {"target_precision": "target"},
    "ImageAnnotate": {"annotation_mode": "annotation_type"},
    "marching_cubes": {"resolution": "voxel_size"},
    "depth_to_pointcloud": {"fx": "focal_length_x", "fy": "focal_length_y", "cx": "center_x", "cy": "center_y"},
}

REGISTRY: dict[str, Operator] = {}
ALIASES: dict[str, str] = {}


def register(op: Operator, *aliases: str) -> Operator:
    if op.type_id in REGISTRY:
        raise FlowError(f"{op.type_id} is registered twice")
    REGISTRY[op.type_id] = op
    for a in aliases:
        ALIASES[a] = op.type_id
    return op


def find(type_id: str) -> Operator:
    """The operator of a type id or alias."""
    load()
    try:
        return REGISTRY[ALIASES.get(type_id, type_id)]
    except KeyError:
        raise FlowError(f"unknown operator type: {type_id}") from None


def load() -> None:
    from .operators import clouds, codes, devices, features, geometry, images, industry, inspect, measures, models, reconstruct, relational, scene  # noqa: F401
