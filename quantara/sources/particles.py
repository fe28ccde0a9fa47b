"""From any DataFrame or folder to the logical particle view (row_id, id, x, y, z, vx, vy, vz)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantara.fields import ALIASES, FLOATS, INTEGERS, ITEM_BYTES, LOGICAL, POSITIONS, VELOCITIES, ParticleError
from quantara.functions.scalar import positive_scale

#: File offsets are broadcast up to so many files; beyond, the join shuffles them.
BROADCAST_FILES = 100_000
NUMERIC = (*INTEGERS, *FLOATS)


@dataclass(frozen=True)
class Scale:
    value: float
    source: str  # value, attr, raw, auto_attr, auto_raw


@dataclass(frozen=True)
class Source:
    """A resolved table: the view, where its fields were found and their types."""

    view: DataFrame
    paths: dict[str, str]
    types: dict[str, str]
    attributes: dict[str, float | str]

    def item_bytes(self, fields=LOGICAL) -> int:
        return sum(ITEM_BYTES[self.types[f]] for f in fields)


def _leaves(schema: StructType, at: tuple[str, ...] = ()):
    for f in schema.fields:
        if isinstance(f.dataType, StructType):
            yield from _leaves(f.dataType, (*at, f.name))
        else:
            yield (*at, f.name), f.dataType.simpleString()


def resolve_fields(schema: StructType, logical=LOGICAL) -> tuple[dict[str, str], dict[str, str]]:
    """({logical: column path}, {logical: type}) by the leaf's name without case; of equal names the last counts."""
    found = {path[-1].lower(): (".".join(f"`{p}`" for p in path), kind) for path, kind in _leaves(schema)}
    paths, types = {}, {}
    for name in logical:
        hit = next((found[a] for a in ALIASES[name] if a in found), None)
        if hit is None:
            raise ParticleError(f"no column for {name!r}; looked for {', '.join(ALIASES[name])}")
        paths[name], types[name] = hit
    return paths, types


def check_types(types: dict[str, str]) -> None:
    if types.get("id", "bigint") not in INTEGERS:
        raise ParticleError(f"id must be an integer column, not {types['id']}")
    for name in POSITIONS:
        if types.get(name, "float") not in NUMERIC:
            raise ParticleError(f"{name} must be numeric, not {types[name]}")
    for name in VELOCITIES:
        if types.get(name, "float") not in FLOATS:
            raise ParticleError(f"{name} must be float or double, not {types[name]}")


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """File-backed rows with their place: files in order of their paths, rows as they stand in each.

    Only a count a file is needed, which Parquet answers from its footers.
    """
    files = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = sorted((r["__file"], r["count"]) for r in files.groupBy("__file").count().collect())
    if len(counts) == 1:
        return files.withColumn(name, F.col("__row")).drop("__file", "__row")
    offsets, total = [], 0
    for path, n in counts:
        offsets.append((path, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__file string, __offset long")
    table = F.broadcast(table) if len(offsets) <= BROADCAST_FILES else table
    return files.join(table, "__file").withColumn(name, F.col("__offset") + F.col("__row")).drop("__file", "__row", "__offset")


def row_count(df: DataFrame, limit: int | None = None) -> int:
    if limit is not None and limit <= 0:
        raise ParticleError("limit must be positive")
    n = df.count()
    return n if limit is None else min(n, limit)


def particles(df: DataFrame, *, row_id: str | None = None, limit: int | None = None, attributes: dict | None = None) -> Source:
    """Resolve ``df`` to a Source. ``row_id`` names the column that orders the rows; without it, file order does."""
    if limit is not None and limit <= 0:
        raise ParticleError("limit must be positive")
    paths, types = resolve_fields(df.schema)
    check_types(types)
    if row_id is None:
        df, row_id = with_row_ids(df), "row_id"
    view = df.select(F.col(row_id).cast("long").alias("row_id"), *(F.expr(paths[n]).alias(n) for n in LOGICAL))
    if limit is not None:
        view = view.where(F.col("row_id") < limit)  # a prefix by place, pushed to the scan where row_id is a column
    return Source(view, paths, types, dict(attributes or {}))


def resolve_scale(types: dict[str, str], attributes: dict, mode: str = "auto", attribute: str = "bitwidth", value: float | None = None) -> Scale:
    """Scale of the positions; ``auto`` takes the attribute if x is an integer and the attribute positive."""
    if mode == "value":
        if value is None:
            raise ParticleError("scale mode 'value' needs a value")
        return Scale(positive_scale(value), "value")
    if mode == "raw":
        return Scale(1.0, "raw")
    if mode == "attr":
        if attribute not in attributes:
            raise ParticleError(f"the table has no attribute {attribute!r} for the scale")
        return Scale(positive_scale(float(attributes[attribute])), "attr")
    if mode != "auto":
        raise ParticleError(f"scale modes are value, attr, raw and auto, not {mode!r}")
    if types["x"] in INTEGERS and float(attributes.get(attribute) or 0) > 0:
        return Scale(float(attributes[attribute]), "auto_attr")
    return Scale(1.0, "auto_raw")


def check_finite(view: DataFrame, fields=POSITIONS + VELOCITIES) -> None:
    """Refuse nulls, NaN and infinities, naming the fields."""
    bad = {f: F.sum(F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), 1).otherwise(0)) for f in fields}
    row = view.agg(*(c.alias(f) for f, c in bad.items())).first()
    wrong = [f for f in fields if row[f]]
    if wrong:
        raise ParticleError(f"null, NaN or infinite values in {', '.join(wrong)}")


def triplets(view: DataFrame, fields=POSITIONS) -> DataFrame:
    """(row_id, triplet): three columns as one array of floats."""
    return view.select("row_id", F.array(*(F.col(f).cast("float") for f in fields)).alias("triplet"))


def interleaved(view: DataFrame, fields=POSITIONS) -> DataFrame:
    """(pos, value): the flat stream x1, y1, z1, x2, ... by place."""
    return triplets(view, fields).select("row_id", F.posexplode("triplet").alias("axis", "value")).select((F.col("row_id") * len(fields) + F.col("axis")).alias("pos"), "value")


def deinterleaved(stream: DataFrame, fields=POSITIONS) -> DataFrame:
    """(row_id, fields) of (pos, value); every triplet must be whole."""
    n = len(fields)
    rows = stream.select(F.expr(f"pos div {n}").alias("row_id"), (F.col("pos") % n).alias("axis"), "value")
    out = rows.groupBy("row_id").agg(*(F.max(F.when(F.col("axis") == k, F.col("value"))).alias(f) for k, f in enumerate(fields)), F.count("*").alias("__n"))
    whole = F.assert_true(F.col("__n") == n, F.lit("a triplet is not whole"))
    return out.where(F.coalesce(whole.cast("boolean"), F.lit(True))).drop("__n")


def triplets_split(rows: DataFrame, fields=POSITIONS) -> DataFrame:
    """(row_id, fields) of (row_id, triplet)."""
    return rows.select("row_id", *(F.get("triplet", k).alias(f) for k, f in enumerate(fields)))


def discover(spark: SparkSession, directory: str, suffix: str = ".parquet") -> list[str]:
    """Tables directly in a folder, by exact suffix, in order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ParticleError(f"{directory} does not exist")
    found = sorted(str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().endswith(suffix))
    if not found:
        raise ParticleError(f"no *{suffix} in {directory}")
    return found


def file_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes) of all files below a folder, relative to it; contents are not read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(directory)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    # A qualified local path has one slash after the scheme, a listed one three.
    clean = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
    return files.select(F.substring(clean(F.col("path")), F.length(clean(F.lit(root))) + 2, F.lit(1 << 20)).alias("path"), F.col("length").alias("bytes"))
