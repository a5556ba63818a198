"""Laplacians of whole labelled clouds of any dimension, at several radii.

Every kind of filtration is the same flag complex of a distance threshold; the names are accepted for compatibility.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.windows import min_max, position
from .balls import laplacian_entries
from .spectral import laplacians, local_spectra, spectrum_statistics

# Names of filtrations.
KINDS = ("alpha", "rips", "distance")


def scaled_labels(labels: np.ndarray) -> np.ndarray:
    """Labels mapped to 0..1 by their finite ones; all zero where none is finite or all are nearly equal."""
    finite = labels[np.isfinite(labels)]
    if not len(finite) or np.isclose(finite.min(), finite.max()):
        return np.zeros(len(labels))
    return (labels - finite.min()) / (finite.max() - finite.min())


class Cloud:
    """Points (n x k) with labels, and their Laplacians of degree 0, 1 and 2 at each radius."""

    def __init__(self, points, labels=None, kind: str = "alpha", radii: Sequence[float] | None = None, p: float = 0.0, constant: bool = True, scale: bool = False):
        self.points = np.asarray(points, float)
        self.radii = np.asarray([np.inf] if radii is None else radii, float).ravel()
        self.p, self.constant = float(p), bool(constant)
        if self.points.ndim != 2 or not np.isfinite(self.points).all():
            raise ValueError("points must be a two-dimensional array of finite numbers")
        if kind.lower() not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if not len(self.radii) or np.isnan(self.radii).any() or (self.radii < 0).any():
            raise ValueError("radii must be one number or more, none negative")
        if not self.p >= 0:
            raise ValueError("p must not be negative")
        own = np.zeros(len(self.points)) if labels is None else np.asarray(labels, float).ravel()
        if len(own) != len(self.points) or not np.isfinite(own).all():
            raise ValueError("labels must be finite, one for each point")
        self.labels = scaled_labels(own) if scale else own

    def _each(self, make, degree: int) -> list[np.ndarray]:
        return [make(self.points, None if self.constant else self.labels, r, self.p, (degree,))[degree] for r in self.radii.tolist()]

    def matrices(self, degree: int = 0) -> list[np.ndarray]:
        """The Laplacian of a degree at each radius."""
        return self._each(laplacians, degree)

    def eigenvalues(self, degree: int = 0) -> list[np.ndarray]:
        """Its eigenvalues at each radius, in ascending order."""
        return self._each(local_spectra, degree)


def _by_group(points: DataFrame, group: str, order: str, coordinates: list[str], label: str | None, schema: str, rows, **options) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kind = dict(points.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cloud = Cloud(pdf[coordinates].to_numpy(float), None if label is None else pdf[label].to_numpy(float), **options)
        made = pd.DataFrame(rows(cloud), columns=names)
        made.insert(0, group, pdf[group].iloc[0])
        return made

    own = points.select(group, order, *coordinates, *([label] if label else []))
    return own.groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}")


def _entries(points: DataFrame, group: str, order: str, coordinates: list[str], label: str | None, radii: list[float], p: float, constant: bool, scale: bool) -> DataFrame:
    """cloud_matrices() of degree 0 by neighbouring points; ids are places in the group's order."""
    Cloud(np.zeros((0, 3)), radii=radii, p=p)  # refuses what a cloud refuses
    held = lambda c, text: F.when(finite(F.col(c)), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(text)).cast("double"))
    axes = [held(c, "points must be a two-dimensional array of finite numbers").alias(a) for a, c in zip("xyz", coordinates, strict=False)]
    axes += [F.lit(0.0).alias(a) for a in "xyz"[len(coordinates) :]]
    own = F.lit(0.0) if label is None or constant else held(label, "labels must be finite, one for each point")
    rows = points.select(F.col(group).alias("grp"), position([group], [order]).cast("long").alias("id"), *axes, own.alias("label"))
    if scale:
        rows = rows.withColumn("label", min_max("label", ["grp"]))
    return laplacian_entries(rows, radii, p).withColumnRenamed("grp", group)


def cloud_matrices(points: DataFrame, group: str, order: str, coordinates: list[str], label: str | None, radii: list[float], p: float = 0.0, degree: int = 0, constant: bool = True, scale: bool = False) -> DataFrame:
    """(group, radius, i, j, value): the entries that are not zero of each group's Laplacian, simplices numbered from 0 in order.

    Degree 0 of clouds of up to three dimensions at finite radii comes from the pairs within the largest radius, a few rows at a
    time. Otherwise a group is one cloud and fits a task (MAX_CELLS).
    """
    if degree == 0 and len(coordinates) <= 3 and np.isfinite(radii).all():
        return _entries(points, group, order, coordinates, label, radii, p, constant, scale)

    def rows(cloud: Cloud) -> list[tuple]:
        out = []
        for r, m in zip(cloud.radii.tolist(), cloud.matrices(degree), strict=True):
            i, j = np.nonzero(m)
            out += zip([r] * len(i), i.tolist(), j.tolist(), m[i, j].tolist(), strict=True)
        return out

    return _by_group(points, group, order, coordinates, label, "radius double, i long, j long, value double", rows, radii=radii, p=p, constant=constant, scale=scale)


def cloud_statistics(points: DataFrame, group: str, order: str, coordinates: list[str], label: str | None, radii: list[float], p: float = 0.0, degrees: tuple[int, ...] = (0,), constant: bool = True, scale: bool = False) -> DataFrame:
    """(group, radius, degree, stat, value): spectrum_statistics() of each group's Laplacians. A group fits a task."""

    def rows(cloud: Cloud) -> list[tuple]:
        return [
            (r, k, stat, value)
            for k in degrees
            for r, values in zip(cloud.radii.tolist(), cloud.eigenvalues(k), strict=True)
            for stat, value in spectrum_statistics(values).items()
        ]

    return _by_group(points, group, order, coordinates, label, "radius double, degree int, stat string, value double", rows, radii=radii, p=p, constant=constant, scale=scale)
