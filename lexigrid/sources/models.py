"""Tagger models as JSON (one file on the driver) and as Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

Parts = tuple[dict[str, dict[str, float]], dict[str, str], set[str]]


def weights_df(spark: SparkSession, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(feature, weights map); a feature without weights has an empty map."""
    return spark.createDataFrame(list(weights.items()), "feature string, weights map<string,double>")


def tagdict_df(spark: SparkSession, tagdict: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(tagdict.items()), "word string, tag string")


def classes_df(spark: SparkSession, classes: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in sorted(classes)], "class string")


def to_json(weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]) -> str:
    """Only weights, dictionary and classes; no parameters or counters."""
    return json.dumps({"classes": sorted(classes), "tagdict": tagdict, "weights": weights}, ensure_ascii=False, indent=2, sort_keys=True)


def from_json(text: str, current: Parts, path: str = "<text>") -> Parts:
    """The text's parts, and of `current` those it lacks. All are checked before any is returned."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise OSError(f"A file is at {path}, but it can't be read as a tagger model; it may be damaged. Error: {e}") from e
    data = data if isinstance(data, dict) else {}
    weights, tagdict, classes = current
    if "weights" in data:
        weights = _mapping(data["weights"], "weights", lambda own: {c: _number(w) for c, w in _mapping(own, "weights", lambda w: w).items()})
    if "tagdict" in data:
        tagdict = _mapping(data["tagdict"], "tagdict", lambda t: _string(t, "tagdict"))
    if "classes" in data:
        if not isinstance(data["classes"], list):
            raise ValueError("Failed to parse classes: not a list")
        classes = {_string(c, "classes") for c in data["classes"]}
    return weights, tagdict, classes


def save_json(path: str, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]) -> None:
    try:
        f = open(path, "w", encoding="utf-8")
    except OSError as e:
        raise OSError(f"Failed to create file: {e}") from e
    with f:
        f.write(to_json(weights, tagdict, classes))


def load_json(path: str, current: Parts) -> Parts:
    """from_json() of a file."""
    try:
        f = open(path, "rb")
    except OSError as e:
        raise FileNotFoundError(f"Can't locate tagger model {path}") from e
    with f:
        try:
            text = f.read().decode()
        except ValueError as e:
            raise OSError(f"A file is at {path}, but it can't be read as a tagger model; it may be damaged. Error: {e}") from e
    return from_json(text, current, path)


def _mapping(x, name: str, read) -> dict:
    if not isinstance(x, dict):
        raise ValueError(f"Failed to parse {name}: not an object")
    return {k: read(v) for k, v in x.items()}


def _string(x, name: str) -> str:
    if not isinstance(x, str):
        raise ValueError(f"Failed to parse {name}: not a string")
    return x


def _number(x) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise ValueError("Failed to parse weights: not a number")
    return float(x)


def save_parquet(spark: SparkSession, path: str, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]) -> None:
    for name, df in (("weights", weights_df(spark, weights)), ("tagdict", tagdict_df(spark, tagdict)), ("classes", classes_df(spark, classes))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_parquet(spark: SparkSession, path: str) -> Parts:
    read = lambda name: spark.read.parquet(f"{path}/{name}").collect()
    return {r.feature: dict(r.weights) for r in read("weights")}, {r.word: r.tag for r in read("tagdict")}, {r["class"] for r in read("classes")}
