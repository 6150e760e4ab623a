"""Settings: nested defaults under a nested override, checked by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS: dict = {
    "cells": {"min_umis": 2.0, "separator": "_"},
    "distance": {"percent": 1.0, "digits": 4},
    "labels": {"most_q": 0.15, "share": 0.75, "reps": 200},
    "raster": {"sigma": 2.0, "voxel": 2.0, "reach": 3.0},
}


def merge(base: dict, over: dict, path: str = "") -> dict:
    """``over`` in ``base``, recursively; a name that ``base`` lacks raises KeyError."""
    out = dict(base)
    for k, v in over.items():
        if k not in base:
            raise KeyError(f"unknown setting {path}{k}")
        out[k] = merge(base[k], v, f"{path}{k}.") if isinstance(base[k], dict) else v
    return out


def settings(doc: Column, base: dict = DEFAULTS, path: str = "$") -> Column:
    """The settings of a row as nested structs: each from the row's JSON document ``doc`` where it names one, else the default.
    Nulls, in the document or for it, leave the default."""
    kind = {float: "double", int: "long", str: "string", bool: "boolean"}
    leaf = lambda k, v: F.coalesce(F.get_json_object(doc, f"{path}.{k}").try_cast(kind[type(v)]), F.lit(v))
    return F.struct(*[(settings(doc, v, f"{path}.{k}") if isinstance(v, dict) else leaf(k, v)).alias(k) for k, v in base.items()])


def unknown(doc: Column, base: dict = DEFAULTS, path: str = "$") -> Column:
    """The names in a row's JSON document that ``base`` lacks, with their paths; none for a null document."""
    none = F.array().cast("array<string>")
    names = F.coalesce(F.json_object_keys(F.get_json_object(doc, path)), none)
    own = F.transform(F.filter(names, lambda n: ~n.isin(*base)), lambda n: F.concat(F.lit(f"{path}."[2:]), n))
    return F.concat(own, *[unknown(doc, v, f"{path}.{k}") for k, v in base.items() if isinstance(v, dict)])


@dataclass(frozen=True)
class Arm:
    """The extension point: one way to describe items, as column names and parameters of the same operators."""

    name: str
    ident: str
    vector: str
    label: str
    percent: float = 1.0
    strata: dict[str, tuple[str, ...]] = field(default_factory=dict)
