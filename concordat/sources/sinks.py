"""Writers: partitioned JSON, versioned store, cache entries, CSV, typed key-value rows, several at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(frame: DataFrame, path: str, by: list[str], compression: str = "none") -> None:
    frame.write.mode("overwrite").partitionBy(*by).option("compression", compression).json(path)


def write_versioned(frame: DataFrame, path: str, version: str) -> None:
    """Append one version; readers take the newest per record."""
    frame.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def write_cache(frame: DataFrame, path: str, ttl_seconds: int) -> None:
    now = F.current_timestamp()
    frame.withColumn("cached_at", now).withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds))).write.mode("append").parquet(path)


def live_cache(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("expires_at") > F.current_timestamp())


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def tagged(frame: DataFrame) -> Column:
    """A row as JSON of type-tagged values: S text, N number, BOOL boolean, L list; nulls are left out."""
    tags = {"string": "S", "boolean": "BOOL"}
    cells = []
    for field in frame.schema.fields:
        kind = field.dataType.simpleString()
        tag = tags.get(kind, "L" if kind.startswith("array") else "N")
        value = F.to_json(F.struct(F.col(f"`{field.name}`").alias(tag))) if tag in ("BOOL", "L", "S") else F.to_json(F.struct(F.col(f"`{field.name}`").cast("string").alias(tag)))
        cells.append(F.when(F.col(f"`{field.name}`").isNotNull(), F.concat(F.lit(f'"{field.name}":'), value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def untagged(text: Column, schema: str) -> Column:
    """Struct of the fields of a DDL schema out of JSON of type-tagged values; absent fields are null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    tags = {"string": "S", "boolean": "BOOL"}
    one = lambda name, kind: F.try_variant_get(F.try_parse_json(text), f"$.{name}.{tags.get(kind, 'L' if kind.startswith('array') else 'N')}", "string" if kind not in ("boolean",) and not kind.startswith("array") else kind)
    return F.struct(*[one(n, k).try_cast(k).alias(n) if not k.startswith("array") else one(n, k).alias(n) for n, k in fields])


def metadata_row(records: Column, paths: dict[str, str]) -> Column:
    """Struct of single values out of JSON records, by name and path, as text."""
    v = F.try_parse_json(records)
    return F.struct(*[F.try_variant_get(v, f"$.{p}", "string").alias(n) for n, p in paths.items()])


def write_latest(frame: DataFrame, path: str, version: str, key: str) -> None:
    """Append one version as gzipped JSON, then replace the pointer that names the newest version of each record."""
    frame.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").option("compression", "gzip").json(f"{path}/versions")
    newest = frame.sparkSession.read.json(f"{path}/versions").groupBy(key).agg(F.max(F.col("version").cast("string")).alias("version"))
    newest.write.mode("overwrite").parquet(f"{path}/latest")


def write_all(frame: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Run every sink; a failed one does not stop the others. Returns the errors, raises if none succeeded."""
    errors = {}
    for name, sink in sinks.items():
        try:
            sink(frame)
        except Exception as failure:  # noqa: BLE001
            errors[name] = str(failure)[:500]
    if sinks and len(errors) == len(sinks):
        raise RuntimeError(f"every sink failed: {errors}")
    return errors
