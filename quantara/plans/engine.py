"""The engine: preprocess, compress, decompress, round trip, and batches of tables."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantara.fields import GROUPS, INTEGERS, ITEM_BYTES, LOGICAL, POSITIONS, TRIPLET_CODECS, VELOCITIES, ParticleError
from quantara.functions.scalar import order_bits, scaled, unscaled
from quantara.lineage import cut
from quantara.operators import align, chunk, codec, metrics, order, rollup
from quantara.operators.stats import Profile, profile
from quantara.plans import bounds as planner
from quantara.plans.config import Settings
from quantara.sources import package
from quantara.sources.particles import Scale, Source, check_finite, discover, particles, resolve_scale

VERSION = 1


@dataclass(frozen=True)
class Prepared:
    """A table that was looked through and planned for, nothing being written yet."""

    source: Source
    settings: Settings
    scale: Scale
    profile: Profile
    bounds: planner.Bounds
    seconds: float

    @property
    def integer_positions(self) -> dict[str, bool]:
        return {f: self.source.types[f] in INTEGERS for f in POSITIONS}

    @property
    def logical(self) -> DataFrame:
        """The view in logical units."""
        v = self.source.view
        return v.select("row_id", "id", *(scaled(F.col(f), self.scale.value).alias(f) for f in POSITIONS), *(F.col(f).cast("double").alias(f) for f in VELOCITIES))

    def targets(self) -> dict[str, float]:
        return planner.targets(self.settings, self.bounds, self.profile, self.scale.value, self.integer_positions)

    def quantizers(self) -> dict[str, codec.Quantizer]:
        lows = {f: s.minimum for f, s in self.profile.fields.items()}
        b, s = self.bounds, self.settings
        if s.pos_codec in TRIPLET_CODECS:
            out = codec.triplet_quantizers(s.pos_codec, {f: lows[f] for f in POSITIONS}, b.position_codec, b.position_triplet.codec)
        else:
            out = {f: codec.Quantizer(lows[f], b.position_codec) for f in POSITIONS}
        if s.vel_codec == "lattice":
            out |= codec.triplet_quantizers("lattice", {f: lows[f] for f in VELOCITIES}, 0.0, b.velocity_triplet.codec)
        else:
            out |= {f: codec.Quantizer(lows[f], b.velocity_codec[f]) for f in VELOCITIES}
        return out


def prepare(df: DataFrame, settings: Settings | None = None, *, row_id: str | None = None, attributes: dict | None = None) -> Prepared:
    """Options are checked first, then one pass gives the profile, then bounds are planned."""
    settings, started = (settings or Settings()).checked(), time.perf_counter()
    source = particles(df, row_id=row_id, limit=settings.limit, attributes=attributes)
    scale = resolve_scale(source.types, source.attributes, settings.position_scale, settings.position_scale_attr, settings.position_scale_value)
    check_finite(source.view)
    found = profile(source.view, scale.value)
    integers = {f: source.types[f] in INTEGERS for f in POSITIONS}
    return Prepared(source, settings, scale, found, planner.plan(settings, found, scale.value, integers), time.perf_counter() - started)


def ordering(p: Prepared) -> str:
    """Which order becomes the canonical one; a triplet codec's own makes a stored permutation unnecessary."""
    if p.settings.pos_codec in TRIPLET_CODECS:
        return "positions"
    return "id" if p.settings.sort_by_id else "original"


def _ranges(p: Prepared, fields) -> dict[str, tuple[float, float]]:
    return {f: (p.profile.fields[f].minimum, p.profile.fields[f].maximum) for f in fields}


def ranked(p: Prepared) -> DataFrame:
    """The logical view with ``rank``, its place in the canonical order."""
    kind = ordering(p)
    if kind == "positions":
        coded = order.morton_codes(p.logical, POSITIONS, _ranges(p, POSITIONS))
        return order.global_rank(coded, "code", "row_id").drop("code")
    return order.global_rank(p.logical, *(("id", "row_id") if kind == "id" else ("row_id",)))


def compress(p: Prepared, directory: str) -> dict:
    """Write the package; returns the manifest."""
    spark, s, started = p.source.view.sparkSession, p.settings, time.perf_counter()
    package.require_output(spark, f"{directory}/{package.MANIFEST}", s.force)
    package.require_output(spark, f"{directory}/compressed", s.force)
    rows, q = cut(ranked(p)), p.quantizers()
    size = s.vel_chunk_size

    package.write_component(rows.select("rank", "id"), directory, "id")
    coded = codec.encode(rows.select("rank", *POSITIONS), {f: q[f] for f in POSITIONS})
    if s.pos_codec in TRIPLET_CODECS:
        package.write_component(coded, directory, "positions")
    else:
        _write_fields(coded, directory, POSITIONS, s.pos_codec)

    moving = rows.select("rank", *VELOCITIES)
    if s.vel_codec in TRIPLET_CODECS:
        # Velocities have an order of their own, inside chunks of the canonical one if asked for.
        with_codes = order.morton_codes(moving, VELOCITIES, _ranges(p, VELOCITIES))
        chunked = chunk.with_chunks(with_codes, size, place="rank")
        if size:
            own = order.local_order(chunked, "code", "local_idx").withColumn("at", F.col("chunk_id") * size + F.col("k"))
        else:
            own = order.global_rank(chunked, "code", "rank", name="at")
        own = cut(own)
        package.write_component(codec.encode(own.select(F.col("at"), *VELOCITIES), {f: q[f] for f in VELOCITIES}), directory, "velocities", by="at")
        package.write_component(own.select("at", "chunk_id", F.col("local_idx").cast("int" if size else "long")), directory, "velocity_order", by="at")
    else:
        _write_fields(codec.encode(moving, {f: q[f] for f in VELOCITIES}), directory, VELOCITIES, s.vel_codec)
    if ordering(p) != "original":
        # Kept for metrics only; not part of the package's size.
        rows.select("rank", "row_id").write.mode("overwrite").parquet(f"{directory}/temporary/order.parquet")

    package.write_attributes(spark, directory, p.source.attributes, force=True)
    manifest = _manifest(p, directory, time.perf_counter() - started)
    package.write_json(spark, f"{directory}/{package.MANIFEST}", manifest, force=True)
    return manifest


#: Rows of a chunk over which ``delta`` takes differences, so that decoding runs in parallel.
DELTA_CHUNK = 1 << 16


def _write_fields(coded: DataFrame, directory: str, fields, name: str) -> None:
    if name == "delta":
        coded = codec.delta_encode(chunk.with_chunks(coded, DELTA_CHUNK, place="rank").drop("local_idx"), fields).drop("chunk_id")
    for f in fields:
        package.write_component(coded.select("rank", f"q_{f}", f"e_{f}"), directory, f)


def _manifest(p: Prepared, directory: str, seconds: float) -> dict:
    spark, s, n = p.source.view.sparkSession, p.settings, p.profile.count
    original = p.source.item_bytes() * n
    sizes = {r["path"]: r["bytes"] for r in package.component_sizes(spark, directory).collect()}  # files of one package
    reordered = ordering(p) != "original"
    manifest = {
        "format_version": VERSION,
        "count": n,
        "fields": {f: {"path": p.source.paths[f], "type": p.source.types[f]} for f in LOGICAL},
        "attributes": {**p.source.attributes, **({"npart": n} if s.limit and "npart" in p.source.attributes else {})},
        "settings": asdict(s),
        "position_scale": asdict(p.scale),
        "profile": {"id": {"min": p.profile.id_min, "max": p.profile.id_max}, **{f: {"min": x.minimum, "max": x.maximum, "range": x.range, "cast": x.cast} for f, x in p.profile.fields.items()}},
        "bounds": p.bounds.as_dict(),
        "targets": p.targets(),
        "codecs": {"positions": s.pos_codec, "velocities": s.vel_codec, "id": s.lossless},
        "components": package.components(s.pos_codec, s.vel_codec),
        "compressed_fields": {f: {"codec": s.pos_codec if f in POSITIONS else s.vel_codec if f in VELOCITIES else s.lossless, "count": n} for f in LOGICAL},
        "quantizers": {f: asdict(q) for f, q in p.quantizers().items()},
        "ordering": {"kind": ordering(p), "reordered": reordered, "original_order_restored": not reordered},
        "chunks": {"size": s.vel_chunk_size, "count": chunk.chunk_count(n, s.vel_chunk_size), "index_bits": order_bits(min(n, s.vel_chunk_size or n)), "segments": len(chunk.segments(n, s.vel_chunk_size)) if s.vel_chunk_size else 1},
        "timing": {"preprocess_seconds": p.seconds, "compress_seconds": seconds},
        "sizes": {"original_bytes": original, "components": sizes},
    }
    # The manifest counts itself, so its size is a fixed point.
    own = 0
    for _ in range(10):
        total = sum(sizes.values()) + own
        manifest["sizes"] |= {"manifest_bytes": own, "compressed_bytes": total, "compression_ratio": original / total if total else float("inf")}
        new = len(json.dumps(package._plain(manifest), indent=2, sort_keys=True).encode()) + 1
        if new == own:
            break
        own = new
    return manifest


def decompress(spark: SparkSession, directory: str) -> DataFrame:
    """The restored table (rank and the logical fields in source units and types), lazily."""
    m = package.read_json(spark, f"{directory}/{package.MANIFEST}")
    if "compressed_fields" not in m:
        raise ParticleError(f"{directory} holds no compressed fields")
    n, q = m["count"], {f: codec.Quantizer(**x) for f, x in m["quantizers"].items()}
    pos, vel, scale = package.position_codec(m), package.velocity_codec(m), m["position_scale"]["value"]

    for name in m["components"]:  # a short component would else take rows of the others with it
        codec.check_decoded(package.read_component(spark, directory, name), n, name)
    rows = package.read_component(spark, directory, "id")
    if pos in TRIPLET_CODECS:
        positions = codec.decode(package.read_component(spark, directory, "positions"), {f: q[f] for f in POSITIONS})
    else:
        positions = _read_fields(spark, directory, POSITIONS, pos, q)
    if vel in TRIPLET_CODECS:
        size = m["chunks"]["size"]
        stored = codec.decode(package.read_component(spark, directory, "velocities"), {f: q[f] for f in VELOCITIES})
        own = package.read_component(spark, directory, "velocity_order")
        order.check_permutation(own.select((F.col("chunk_id") * size + F.col("local_idx")).alias("row_id")), n, "velocity order")
        if size:
            chunk.check_chunks(own, n, size)
        velocities = stored.join(own, "at").select((F.col("chunk_id") * size + F.col("local_idx")).alias("rank"), *VELOCITIES)
    else:
        velocities = _read_fields(spark, directory, VELOCITIES, vel, q)
    out = rows.join(positions, "rank").join(velocities, "rank")
    types = {f: x["type"] for f, x in m["fields"].items()}
    return out.select("rank", F.col("id").cast(types["id"]).alias("id"), *(unscaled(F.col(f), scale, types[f]).alias(f) for f in POSITIONS), *(F.col(f).cast(types[f]).alias(f) for f in VELOCITIES))


def _read_fields(spark: SparkSession, directory: str, fields, name: str, q) -> DataFrame:
    out = None
    for f in fields:
        rows = package.read_component(spark, directory, f)
        if name == "delta":
            rows = codec.delta_decode(chunk.with_chunks(rows, DELTA_CHUNK, place="rank").drop("local_idx"), [f]).drop("chunk_id")
        rows = codec.decode(rows, {f: q[f]})
        out = rows if out is None else out.join(rows, "rank")
    return out


def write_table(rows: DataFrame, manifest: dict, path: str, force: bool = False) -> None:
    """The restored table under its original column paths (nested ones as structs), in rank order."""
    spark = rows.sparkSession
    package.require_output(spark, path, force)
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "rank").sortWithinPartitions("rank")
    tree: dict = {}
    for f in LOGICAL:
        x = manifest["fields"][f]
        at, *rest = [p.strip("`") for p in x["path"].split("`.`")][::-1]
        node = tree
        for p in reversed(rest):
            node = node.setdefault(p, {})
        node[at] = f

    def build(name, node):
        return F.col(node).alias(name) if isinstance(node, str) else F.struct(*(build(k, v) for k, v in node.items())).alias(name)

    ordered.select(*(build(k, v) for k, v in tree.items())).write.parquet(path)


def aligned_rows(p: Prepared, restored: DataFrame, directory: str) -> DataFrame:
    """Original and restored rows: through the kept order, by place if nothing moved, else by id."""
    spark, kind = restored.sparkSession, ordering(p)
    view = p.source.view
    if kind == "original":
        # Places count only the rows taken, in order; they equal row_id where that is gapless.
        return align.by_place(order.global_rank(view, "row_id").drop("row_id").withColumnRenamed("rank", "row_id"), restored.withColumnRenamed("rank", "row_id"), LOGICAL)
    if package.exists(spark, f"{directory}/temporary/order.parquet"):
        kept = spark.read.parquet(f"{directory}/temporary/order.parquet")
        return align.by_place(view, restored.withColumnRenamed("rank", "row_id"), LOGICAL, order=kept)
    return align.by_id(view, restored, LOGICAL)


def measure(p: Prepared, directory: str) -> dict:
    """Errors, verdicts and sizes of a package against its source."""
    started = time.perf_counter()
    spark, manifest = p.source.view.sparkSession, package.read_json(p.source.view.sparkSession, f"{directory}/{package.MANIFEST}")
    pairs = cut(aligned_rows(p, decompress(spark, directory), directory))
    if pairs.count() != p.profile.count:
        raise ParticleError("restored rows are missing")
    scales = dict.fromkeys(POSITIONS, p.scale.value)
    by_field = metrics.with_verdicts(metrics.field_metrics(pairs, LOGICAL, scales), p.targets())
    report = {r["field"]: r.asDict() for r in by_field.collect()}
    report["id"]["exact_match"] = bool(metrics.exact_match(pairs).first()["exact_match"])
    twins = [f for f in POSITIONS if p.integer_positions[f]]
    if twins and p.scale.value != 1.0:
        for r in metrics.field_metrics(pairs, twins).collect():
            report[r["field"]]["fixed_point_units"] = r.asDict()
    vectors = {}
    for group, fields, used, scale, bound in (
        ("positions", POSITIONS, p.settings.pos_codec, p.scale.value, p.bounds.position_triplet.requested),
        ("velocities", VELOCITIES, p.settings.vel_codec, 1.0, p.bounds.velocity_triplet.requested),
    ):
        if used == "lattice":
            v = metrics.triplet_metrics(pairs, fields, scale).first().asDict()
            vectors[group] = v | {"bound": bound, "bound_ok": v["max_l2"] <= bound + planner.tolerance(bound)}
    sizes, items = package.component_sizes(spark, directory), {f: ITEM_BYTES[p.source.types[f]] for f in LOGICAL}
    return {
        "count": p.profile.count,
        "fields": report,
        "vectors": vectors,
        "components": {r["name"]: r.asDict() for r in rollup.component_ratios(sizes, items, p.profile.count).collect()},
        "field_groups": {r["name"]: r.asDict() for r in rollup.group_ratios(sizes, items, p.profile.count).collect()},
        "sizes": manifest["sizes"],
        "timing": manifest["timing"] | {"metrics_seconds": time.perf_counter() - started},
    }


def roundtrip(df: DataFrame, directory: str, settings: Settings | None = None, *, clean: bool = False, **source) -> dict:
    """Compress, restore, and compare; the report is kept as metrics.json."""
    p = prepare(df, settings, **source)
    compress(p, directory)
    report = measure(p, directory)
    spark = df.sparkSession
    package.write_json(spark, f"{directory}/metrics.json", report, force=True)
    if clean:
        package.remove(spark, f"{directory}/temporary")
    return report


#: Tables of a batch that are worked on at a time, if no number is given.
BATCH_WORKERS = 16


def batch(spark: SparkSession, directory: str, output: str, command: str = "roundtrip", settings: Settings | None = None, attributes: dict | None = None, workers: int = 0) -> dict:
    """A command over the tables of a folder, ``workers`` of them at a time (0: up to BATCH_WORKERS). Each table is one
    set of distributed jobs; one that fails, for whatever reason, is recorded, the others go on, and the report, in
    order of the names, is written before the failure is raised."""
    started = time.perf_counter()

    def one_table(path: str) -> dict:
        name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
        began = time.perf_counter()
        entry = {"file": name, "succeeded": True, "particles": 0, "original_bytes": 0, "compressed_bytes": None, "wall_seconds": 0.0, "error": None, "timings": {}}
        try:
            df, target = spark.read.parquet(path), f"{output}/{name}"
            p = prepare(df, settings, attributes=attributes)
            entry |= {"particles": p.profile.count, "original_bytes": p.source.item_bytes() * p.profile.count, "timings": {"preprocess_seconds": p.seconds}}
            if command != "preprocess":
                report = compress(p, target) if command == "compress" else roundtrip(df, target, settings, attributes=attributes)
                entry |= {"compressed_bytes": report["sizes"]["compressed_bytes"], "timings": report["timing"]}
                if command == "roundtrip":
                    entry |= {"field_groups": report["field_groups"], "quality": {f: {k: x[k] for k in ("max_abs", "mse", "psnr")} for f, x in report["fields"].items() if f != "id"}}
            entry["wall_seconds"] = time.perf_counter() - began
        except Exception as error:  # noqa: BLE001 - a damaged file raises what its reader likes
            entry |= {"succeeded": False, "error": str(error).split("\n")[0] or type(error).__name__}
        return entry

    paths = list(discover(spark, directory))
    with ThreadPoolExecutor(max(1, min(workers or BATCH_WORKERS, len(paths)))) as pool:
        files = list(pool.map(one_table, paths))
    failed = [f"{e['file']}: {e['error']}" for e in files if not e["succeeded"]]
    schema = "file string, succeeded boolean, particles long, original_bytes long, compressed_bytes long, wall_seconds double, timings map<string,double>"
    table = spark.createDataFrame([tuple(e[k] for k in ("file", "succeeded", "particles", "original_bytes", "compressed_bytes", "wall_seconds", "timings")) for e in files], schema)
    groups = [(g, x["original_bytes"], x["compressed_bytes"]) for e in files if e["succeeded"] for g, x in e.get("field_groups", {}).items()]
    totals = rollup.group_totals(spark.createDataFrame(groups, "name string, original_bytes long, compressed_bytes long"), complete=not failed)
    good = table.where("succeeded")
    one = lambda df: (df.first() or {}) and df.first().asDict()
    ratios = good.where("compressed_bytes is not null").withColumn("ratio", F.col("original_bytes") / F.col("compressed_bytes"))
    report = {
        "command": command,
        "totals": rollup.batch_totals(table, time.perf_counter() - started).first().asDict(),
        "field_groups": {r["name"]: r.asDict() for r in totals.collect()},
        "stage_seconds": {r["stage"]: r["seconds"] for r in rollup.stage_seconds(good).collect()},
        "statistics": {"compression_ratio": one(rollup.summary(ratios, "ratio")), "wall_seconds": one(rollup.summary(good, "wall_seconds"))},
        "files": files,
    }
    package.write_json(spark, f"{output}/batch_metrics.json", report, force=True)
    if failed:
        raise ParticleError("; ".join(failed))
    return report


__all__ = ["GROUPS", "Prepared", "aligned_rows", "batch", "compress", "decompress", "measure", "ordering", "prepare", "ranked", "roundtrip", "write_table"]
