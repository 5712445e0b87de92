"""Named datasets, each loaded once."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from weft.session import TABLES, ship_package

Loader = Callable[[SparkSession], DataFrame]


class Datasets:
    """Datasets by name: a loader runs when its dataset is first asked for, and never again.

    What a loader gives is checked against ``columns``, if the dataset has an entry there, and
    registered as a temporary view of its name, so it can be used in SQL as well. Loading is
    declaring: a loader returns a frame and reads nothing but its schema.
    """

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Loader], columns: Mapping[str, list[str]] | None = None):
        self.spark, self.loaders, self.columns = spark, dict(loaders), dict(columns or {})
        self._held: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        return sorted(self.loaders)

    def get(self, name: str) -> DataFrame:
        if name not in self._held:
            if name not in self.loaders:
                raise KeyError(f"no dataset {name!r}; there are {', '.join(self.names())}")
            df = self.loaders[name](self.spark)
            missing = [c for c in self.columns.get(name, []) if c not in df.columns]
            if missing:
                raise ValueError(f"dataset {name!r} has no columns {missing}")
            df.createOrReplaceTempView(name)
            self._held[name] = df
        return self._held[name]


def parquet_datasets(spark: SparkSession, folder: str, names=TABLES) -> Datasets:
    """The Parquet tables ``names`` below ``folder``."""
    ship_package(spark)
    return Datasets(spark, {n: lambda s, n=n: s.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in names})
