"""A table whose every version meets its constraints: a write that doesn't is refused before anyone can read it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A write that broke rules; ``broken``: rows by rule."""

    def __init__(self, broken: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {n}" for k, n in broken.items()))
        self.broken = broken


@dataclass(frozen=True)
class Rules:
    """What must hold for a table's rows.  Nulls break ``required`` alone, as in SQL.

    allowed: values by column.  unique: keys.  references: by column, the table and its column that has the values.
    """

    required: tuple[str, ...] = ()
    allowed: Mapping[str, tuple] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)


class CheckedTable:
    """Versions under ``root``: folders of rows, and for each that was accepted a small table that names its folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        path, files = self._path("accepted/*/_SUCCESS")
        return max((int(f.getPath().getParent().getName()) for f in files.globStatus(path) or []), default=0)

    def read(self) -> DataFrame | None:
        """The rows of the last accepted version."""
        last = self._last()
        return self.spark.read.parquet(f"{self.root}/{self.spark.read.parquet(f'{self.root}/accepted/{last}').first()['folder']}") if last else None

    def replace(self, rows: DataFrame, rules: Rules, only_if_empty: bool = False) -> int:
        """Writes a new version and accepts it if it meets the rules, or raises ``Refused``; the number of rows written.

        Nulls, values and references are counted by the write itself, references through a marker from the other table's keys, so
        the input is computed once.  Equal keys are counted on the folder that was written, from the key's columns alone, by groups that
        are added up before they are shuffled: however many rows share a key, no task gets them all.
        """
        last = self._last()
        if only_if_empty and last and (there := self.read().count()):
            raise Refused({"empty": there})
        marked = rows
        metrics: dict[str, Column] = {f"required {c}": F.col(c).isNull() for c in rules.required}
        metrics |= {f"allowed {c}": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in rules.allowed.items()}
        for n, (c, (other, key)) in enumerate(rules.references.items()):
            there = other.select(F.col(key).alias(f"__key{n}"), F.lit(True).alias(f"__there{n}")).dropDuplicates([f"__key{n}"])
            marked = marked.join(there, F.col(c) == F.col(f"__key{n}"), "left")
            metrics[f"references {c}"] = F.col(c).isNotNull() & F.col(f"__there{n}").isNull()
        seen = Observation()
        folder = f"data/{uuid.uuid4().hex}"
        counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(m).alias(k) for k, m in metrics.items())]
        marked.observe(seen, *counts).select(*rows.columns).write.parquet(f"{self.root}/{folder}")
        found = dict(seen.get)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        for key in rules.unique:
            whole = written.select(*key).dropna()
            found[f"unique {', '.join(key)}"] = whole.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        total = found.pop("rows")
        broken = {k: n for k, n in found.items() if n}
        if broken:
            path, files = self._path(folder)
            files.delete(path, True)
            raise Refused(broken)
        self.spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.parquet(f"{self.root}/accepted/{last + 1}")
        return total


def cascaded(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """children without those whose parent is gone; what refers to no parent stays."""
    there = parents.select(F.col(key).alias("__key"), F.lit(True).alias("__there")).dropDuplicates(["__key"])
    return children.join(there, F.col(column) == F.col("__key"), "left").where(F.col(column).isNull() | F.col("__there")).drop("__key", "__there")
