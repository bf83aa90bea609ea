"""Lists and maps as values that travel by themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dump(value: Column) -> Column:
    """A list or map of texts as one binary."""
    return F.encode(F.to_json(value), "utf-8")


def load_list(data: Column) -> Column:
    return F.from_json(F.decode(data, "utf-8"), "array<string>")


def load_map(data: Column) -> Column:
    return F.from_json(F.decode(data, "utf-8"), "map<string,string>")
