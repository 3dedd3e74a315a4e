"""Where users put their own code: functions of samples, jobs that map and merge, datasets that build themselves, and
things named in a configuration. User code runs in Arrow batches; what it yields is checked against a schema."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that user code gets through before they are handed on.
ROWS = 1000


def each_sample(df: DataFrame, key: str, f: Callable[[Any, dict], Mapping | Iterable[Mapping] | None], schema: str) -> DataFrame:
    """f(key, row as a dict) of each row: a mapping is one row of the schema, an iterable as many as it yields, None
    none. A value that the schema does not take fails the query; a key that the mapping lacks is null."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out: list[dict] = []
                for row in batch.slice(at, ROWS).to_pylist():
                    made = f(row[key], row)
                    out += [dict(made)] if isinstance(made, Mapping) else [] if made is None else [dict(m) for m in made]
                if extra := {k for m in out for k in m} - set(arrow.names):
                    raise ValueError(f"the schema has no {sorted(extra)}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A dataset's own transform, then those of all datasets; None is no step."""
    for step in steps:
        df = df if step is None else step(df)
    return df


def map_merge(df: DataFrame, key: str, forward: Callable[[Any, dict], Any], schema: str, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A job in two steps: each sample's records are written under a path, and what was written is merged. A lost task is
    repeated and its records are written once."""
    each_sample(df, key, forward, schema).write.parquet(path)
    return merge(df.sparkSession.read.schema(StructType.fromDDL(schema)).parquet(path))


def measured(metrics: Mapping[str, Callable[[DataFrame], DataFrame]], test_sets: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, test_set, name, value): every metric (a function that gives one row of numbers) of every test set."""
    out = None
    for test, rows in test_sets.items():
        for metric, f in metrics.items():
            r = f(rows)
            values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in r.columns]))
            part = r.select(F.lit(metric).alias("metric"), F.lit(test).alias("test_set"), values.alias("v")).select("metric", "test_set", "v.*")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there is nothing to measure")
    return out


class Builder(Protocol):
    """A dataset that can make itself: from where it comes, and as a table."""

    def is_source_prepared(self) -> bool: ...
    def prepare_source(self) -> None: ...
    def is_built(self) -> bool: ...
    def build(self, spark: SparkSession) -> None: ...
    def path(self) -> str: ...


def built(spark: SparkSession, builder: Builder) -> DataFrame:
    """The dataset's table; whatever is not there yet is made first, and checked."""
    if not builder.is_built():
        if not builder.is_source_prepared():
            builder.prepare_source()
            if not builder.is_source_prepared():
                raise RuntimeError("the source is not there after it was prepared")
        builder.build(spark)
        if not builder.is_built():
            raise RuntimeError("the dataset is not there after it was built")
    return spark.read.parquet(builder.path())


def from_config(config: Any, allowed: tuple[str, ...]) -> Any:
    """A configuration with every {_target_: module.name, ...} replaced by what that name gives for the other entries.
    Only names under the modules allowed are imported."""
    if isinstance(config, Mapping):
        said = {k: from_config(v, allowed) for k, v in config.items() if k != "_target_"}
        if "_target_" not in config:
            return said
        module, _, name = str(config["_target_"]).rpartition(".")
        if not any(module == a or module.startswith(f"{a}.") for a in allowed):
            raise ValueError(f"{config['_target_']} is not under {', '.join(allowed)}")
        return getattr(importlib.import_module(module), name)(**said)
    return [from_config(x, allowed) for x in config] if isinstance(config, list) else config
