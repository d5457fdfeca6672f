"""Scalar expressions: tolerant coercions, grid ids, decay weights, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid-cell id rule.
GRID_PRIME_X = 73856093
GRID_PRIME_Y = 19349663
GRID_CLUSTERS = 500
GRID_SCALE = 100


def grid_cell(coordinate: Column, scale: int = GRID_SCALE) -> Column:
    """Cell index of a coordinate, truncated toward zero."""
    return (coordinate * F.lit(scale)).cast("bigint")


def grid_cluster(cell_x: Column, cell_y: Column, n: int = GRID_CLUSTERS) -> Column:
    """Stable id in ``[0, n)`` for a 2-D grid cell."""
    mixed = cell_x * F.lit(GRID_PRIME_X).cast("bigint") + cell_y * F.lit(GRID_PRIME_Y).cast("bigint")
    return F.pmod(mixed, F.lit(n).cast("bigint"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def cluster_name(status: Column, index: Column) -> Column:
    return F.concat_ws("-", status, index.cast("string"))


def decayed_weight(weight: Column, elapsed: Column, decay: float) -> Column:
    """Weight after ``elapsed`` time units of exponential fading, base 2."""
    return weight * F.pow(F.lit(2.0), F.lit(-decay) * elapsed)


def prune_period(decay: float, beta: float, mu: float) -> int:
    """Shortest time in which a just-promoted micro-cluster can fade below the core weight."""
    core = beta * mu
    if core <= 1:
        raise ValueError(f"beta * mu must be greater than 1, got {core}")
    if decay <= 0:
        raise ValueError(f"decay_factor must be greater than 0, got {decay}")
    return math.ceil(math.log2(core / (core - 1)) / decay)


def outlier_floor(now: Column, created: Column, decay: float, period: int) -> Column:
    """Lowest weight that a still-growing outlier micro-cluster of that age may have."""
    top = F.pow(F.lit(2.0), F.lit(-decay) * (now - created + F.lit(period))) - 1
    return top / F.lit(2.0 ** (-decay * period) - 1)


# Tolerant coercions of one field of a JSON value held as a variant. A missing field has
# no kind at all, an explicit null has the kind VOID.

def json_kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is_number(kind: Column) -> Column:
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL"), F.lit(False)
    )


def as_float(value: Column, path: str) -> Column:
    """Number as double; text, objects and nulls give NULL."""
    return F.when(_is_number(json_kind(value, path)), F.try_variant_get(value, path, "double"))


def as_int(value: Column, path: str, numeric_text: bool = True) -> Column:
    """Number cut to bigint; integer text counts too unless ``numeric_text`` is off."""
    kind = json_kind(value, path)
    usable = _is_number(kind) | (F.coalesce(kind == "STRING", F.lit(False)) & F.lit(numeric_text))
    return F.when(usable, F.try_variant_get(value, path, "bigint"))


def as_str(value: Column, path: str) -> Column:
    """Any scalar as text; null and missing give NULL."""
    return F.when(json_kind(value, path) != "VOID", F.try_variant_get(value, path, "string"))


def as_id(value: Column, path: str) -> Column:
    """Integer or text id as text; fractional numbers and the rest give NULL."""
    kind = json_kind(value, path)
    return F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(value, path, "string"))


def as_coordinate(value: Column, path: str, default: float = 0.0) -> Column:
    """Number or numeric text as double, ``default`` when missing, NULL when unusable."""
    kind = json_kind(value, path)
    usable = _is_number(kind) | (kind == "STRING")
    return (
        F.when(kind.isNull(), F.lit(default))
        .when(usable, F.try_variant_get(value, path, "double"))
    )
