"""Layered configuration: defaults, file, profile, environment, command line; later ones win."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import fields
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.formatting import UNITS
from kindred.schema import ScanOptions
from kindred.sources.files import parse_named_root

PREFIX = "KINDRED_"


def merged(low: dict, high: Mapping) -> dict:
    """``high`` over ``low``, table by table; None leaves what is there."""
    out = dict(low)
    for k, v in high.items():
        if isinstance(v, Mapping):
            out[k] = merged(out[k] if isinstance(out.get(k), dict) else {}, v)
        elif v is not None:
            out[k] = v
    return out


def from_environment(env: Mapping[str, str], prefix: str = PREFIX) -> dict:
    """``PREFIX_A__B=1`` as {"a": {"b": 1}}; values are read as TOML where they are."""
    out: dict = {}
    for name, text in env.items():
        if name.startswith(prefix):
            *tables, key = name[len(prefix) :].lower().split("__")
            try:
                value: Any = tomllib.loads(f"x = {text}")["x"]
            except tomllib.TOMLDecodeError:
                value = text
            reduce(lambda t, k: t.setdefault(k, {}), tables, out)[key] = value
    return out


def load(defaults: dict, path: str | None = None, profile: str | None = None, cli: dict | None = None, env: Mapping[str, str] | None = None) -> dict:
    layers: list[Mapping] = []
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            file = tomllib.load(f)
        profiles = file.pop("profile", {})
        layers.append(file)
        if profile is not None:
            if profile not in profiles:
                raise KeyError(f"no profile {profile!r}")
            layers.append(profiles[profile])
    layers += [from_environment(os.environ if env is None else env), cli or {}]
    return reduce(merged, layers, defaults)


def bytes_of(text: str | int) -> int:
    """The bytes of a size literal."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in UNITS:
        raise ValueError(f"no size: {text!r}")
    return int(float(found[1]) * UNITS[found[2].upper()])


def options(config: Mapping) -> ScanOptions:
    """The scan options of a loaded configuration. Sizes may be literals, lists stand for tuples, and
    named roots are NAME=PATH or a table of paths by name; a key that no option has is an error that
    names the nearest one."""
    known, out = [f.name for f in fields(ScanOptions)], {}
    for key, value in config.items():
        if key not in known:
            near = suggestion(key, known)
            raise ValueError(f"unknown key {key!r}" + (f", did you mean {near!r}?" if near else ""))
        if key in ("min_size", "max_size"):
            value = bytes_of(value)
        elif key == "named_roots":
            pairs = value.items() if isinstance(value, Mapping) else map(parse_named_root, value)
            value = {path: name for name, path in pairs}
        elif isinstance(value, list):
            value = tuple(value)
        out[key] = value
    return ScanOptions(**out)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(key: str, known: list[str], most: int = 3) -> str | None:
    """The nearest known key within ``most`` edits, the first of equals."""
    best = min(((distance(key, k), i, k) for i, k in enumerate(known)), default=None)
    return best[2] if best and best[0] <= most else None


def suggested(key: Column, known: list[str], most: int = 3) -> Column:
    """The same for a column of keys."""
    nearest = F.array_min(F.array(*[F.struct(F.levenshtein(key, F.lit(k)).alias("away"), F.lit(i).alias("at"), F.lit(k).alias("key")) for i, k in enumerate(known)]))
    return F.when(nearest["away"] <= most, nearest["key"])
