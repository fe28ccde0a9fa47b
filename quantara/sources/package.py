"""Packages: a folder of Parquet components and a manifest.

<dir>/manifest.json              sorted keys, indented, with a last line break
<dir>/compressed/<component>.parquet/  id, positions or x y z, velocities or vx vy vz, velocity_order
<dir>/attributes.parquet/        (scope, name, type, value)

All components carry ``rank``, the place in the canonical order, and are laid out by it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantara.fields import TRIPLET_CODECS, ParticleError
from quantara.sources.particles import file_sizes

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def require_output(spark: SparkSession, path: str, force: bool) -> None:
    """Refuse to overwrite unless forced to."""
    if exists(spark, path):
        if not force:
            raise ParticleError(f"{path} exists; use force to overwrite it")
        remove(spark, path)


def write_json(spark: SparkSession, path: str, value: dict, force: bool = False) -> int:
    """Sorted keys, two blanks, a last line break; infinite numbers as text. Returns the bytes."""
    require_output(spark, path, force)
    text = json.dumps(_plain(value), indent=2, sort_keys=True, allow_nan=False) + "\n"
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return len(text.encode())


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    return value


def read_json(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise ParticleError(f"{path} does not exist")
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0])


def components(pos_codec: str, vel_codec: str) -> list[str]:
    """The component tables of a pair of codecs."""
    out = ["id"]
    out += ["positions"] if pos_codec in TRIPLET_CODECS else ["x", "y", "z"]
    out += ["velocities", "velocity_order"] if vel_codec in TRIPLET_CODECS else ["vx", "vy", "vz"]
    return out


def component_path(directory: str, name: str) -> str:
    return f"{directory}/compressed/{name}.parquet"


def write_component(rows: DataFrame, directory: str, name: str, by: str = "rank", parts: int | None = None) -> None:
    """A component in order of ``by``: ranges of it, sorted, so sorted codes sit together and readers can skip."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, by).sortWithinPartitions(by)
    laid.write.option("compression", "zstd").mode("errorifexists").parquet(component_path(directory, name))


def read_component(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(component_path(directory, name))


def component_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes) of the components, with paths from their names on."""
    return file_sizes(spark, f"{directory}/compressed").where(F.col("path").contains("part-"))


def write_attributes(spark: SparkSession, directory: str, attributes: dict, force: bool = False) -> None:
    path = f"{directory}/attributes.parquet"
    require_output(spark, path, force)
    rows = [("root", k, type(v).__name__, json.dumps(v)) for k, v in sorted(attributes.items())]
    spark.createDataFrame(rows, "scope string, name string, type string, value string").coalesce(1).write.parquet(path)


def read_attributes(spark: SparkSession, directory: str) -> dict:
    path = f"{directory}/attributes.parquet"
    return {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()} if exists(spark, path) else {}


def position_codec(manifest: dict) -> str:
    """The codec that was used, by what the package holds first, then by what was configured."""
    for f in ("x", "y", "z"):
        if codec := manifest.get("compressed_fields", {}).get(f, {}).get("codec"):
            return codec
    artifacts = manifest.get("components", [])
    if "positions" in artifacts:
        return manifest.get("codecs", {}).get("positions", "sorted")
    return manifest.get("codecs", {}).get("positions", "sorted")


def velocity_codec(manifest: dict) -> str:
    for f in ("vx", "vy", "vz"):
        if codec := manifest.get("compressed_fields", {}).get(f, {}).get("codec"):
            return codec
    return manifest.get("codecs", {}).get("velocities", "linear")
