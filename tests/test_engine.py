import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quantara.__main__ import main
from quantara.fields import LOGICAL, POSITIONS, VELOCITIES, ParticleError, check_codec_pair
from quantara.operators import align, chunk, codec, order, rollup
from quantara.plans import config, engine, report
from quantara.plans.config import Settings
from quantara.sources import package
from quantara.sources import particles as P

LEGAL = [("sorted", v) for v in ("linear", "delta", "sorted", "lattice")] + [("lattice", v) for v in ("linear", "delta", "lattice")] + [(p, v) for p in ("linear", "delta") for v in ("linear", "delta")]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(20)
    rows = [(i, 1000 + 7 * i, rng.uniform(-10, 10), rng.uniform(-20, 20), rng.uniform(-30, 30), rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 3)) for i in range(257)]
    return spark.createDataFrame(rows, "place long, particle_id long, PosX float, posy float, posz float, velx float, vely double, velz float").cache()


def test_legal_pairs():
    codecs = ("sorted", "lattice", "linear", "delta")
    for p in codecs:
        for v in codecs:
            if (p, v) in LEGAL:
                check_codec_pair(p, v)
            else:
                with pytest.raises(ParticleError):
                    check_codec_pair(p, v)


@pytest.mark.parametrize(("pos", "vel", "size"), [("sorted", "linear", 0), ("sorted", "sorted", 64), ("lattice", "lattice", 0), ("lattice", "delta", 0), ("delta", "linear", 0)])
def test_roundtrip_keeps_bounds_and_rows(table, tmp_path, pos, vel, size):
    settings = Settings(pos_codec=pos, vel_codec=vel, pos_abs_eb=0.1, vel_abs_eb=0.05, vel_chunk_size=size, sort=True)
    got = engine.roundtrip(table, str(tmp_path / "p"), settings, row_id="place")
    assert got["count"] == 257 and got["fields"]["id"]["exact_match"]
    assert all(got["fields"][f]["bound_ok"] for f in LOGICAL)
    assert all(v["bound_ok"] for v in got["vectors"].values())
    assert set(got["vectors"]) == {g for g, c in (("positions", pos), ("velocities", vel)) if c == "lattice"}
    assert got["sizes"]["compressed_bytes"] > 0 and report.roundtrip_lines(got)
    assert json.loads((tmp_path / "p" / "metrics.json").read_text())["count"] == 257
    # Without the kept order, rows are aligned by id.
    if engine.ordering(engine.prepare(table, settings, row_id="place")) != "original":
        spark = table.sparkSession
        package.remove(spark, str(tmp_path / "p" / "temporary"))
        again = engine.measure(engine.prepare(table, settings, row_id="place"), str(tmp_path / "p"))
        assert again["fields"]["x"]["max_abs"] == got["fields"]["x"]["max_abs"]


def test_constant_columns_are_exact(spark, tmp_path):
    df = spark.createDataFrame([(i, i, 1.5, 2.5, 3.5, 0.0, 1.0, 0.1) for i in range(10)], "place long, id long, x double, y double, z double, vx double, vy double, vz double")
    got = engine.roundtrip(df, str(tmp_path / "p"), row_id="place")
    assert all(got["fields"][f]["max_abs"] == 0 and got["fields"][f]["psnr"] == math.inf for f in LOGICAL)


def test_fixed_point_positions(spark, tmp_path):
    rng = random.Random(21)
    df = spark.createDataFrame([(i, i, *(rng.randrange(10**6) for _ in range(3)), *(rng.random() for _ in range(3))) for i in range(200)], "place long, id long, x int, y int, z int, vx float, vy float, vz float")
    got = engine.roundtrip(df, str(tmp_path / "p"), Settings(pos_rel_eb=1e-3), row_id="place", attributes={"bitwidth": 100, "npart": 200})
    assert all(got["fields"][f]["bound_ok"] for f in LOGICAL)
    assert got["fields"]["x"]["fixed_point_units"]["max_abs"] == pytest.approx(100 * got["fields"]["x"]["max_abs"])
    out = engine.decompress(spark, str(tmp_path / "p"))
    assert dict(out.dtypes)["x"] == "int"


def test_unsigned_ids(spark, tmp_path):
    ids = [2**63, 7, 2**64 - 1, 11]
    df = spark.createDataFrame([(k, Decimal(i), *[float(k)] * 6) for k, i in enumerate(ids)], "place long, id decimal(20,0), x float, y float, z float, vx float, vy float, vz float")
    engine.roundtrip(df, str(tmp_path / "p"), Settings(pos_codec="linear", sort=True), row_id="place")
    got = [r["id"] for r in engine.decompress(spark, str(tmp_path / "p")).orderBy("rank").collect()]
    assert got == sorted(map(Decimal, ids))


def test_chunked_velocities_and_write_back(spark, table, tmp_path):
    settings = Settings(vel_codec="sorted", vel_chunk_size=64)
    engine.roundtrip(table, str(tmp_path / "p"), settings, row_id="place", clean=True)
    own = package.read_component(spark, str(tmp_path / "p"), "velocity_order")
    assert dict(own.dtypes)["local_idx"] == "int" and own.agg(F.max("local_idx")).first()[0] == 63
    assert main(["decompress", str(tmp_path / "p"), "--output", str(tmp_path / "t")], spark) == 0
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == ["particle_id", "PosX", "posy", "posz", "velx", "vely", "velz"] and back.count() == 257
    assert main(["decompress", str(tmp_path / "p"), "--output", str(tmp_path / "t")], spark) == 2
    assert main(["decompress", str(tmp_path / "p"), "--output", str(tmp_path / "t"), "--force"], spark) == 0


def test_overwrite_guard(table, tmp_path):
    p = engine.prepare(table, row_id="place")
    engine.compress(p, str(tmp_path / "p"))
    with pytest.raises(ParticleError, match="exists"):
        engine.compress(p, str(tmp_path / "p"))
    engine.compress(engine.prepare(table, Settings(force=True), row_id="place"), str(tmp_path / "p"))


def test_damaged_package(spark, table, tmp_path):
    engine.compress(engine.prepare(table, Settings(vel_codec="sorted", vel_chunk_size=64), row_id="place"), str(tmp_path / "p"))
    path = package.component_path(str(tmp_path / "p"), "velocity_order")
    rows = spark.read.parquet(path).where("at <> 70").cache()
    rows.count()
    rows.write.mode("overwrite").parquet(path)
    with pytest.raises(ParticleError):
        engine.decompress(spark, str(tmp_path / "p"))
    with pytest.raises(ParticleError):
        engine.decompress(spark, str(tmp_path / "none"))


def test_a_short_component_is_refused(spark, table, tmp_path):
    engine.compress(engine.prepare(table, Settings(pos_codec="linear", vel_codec="linear"), row_id="place"), str(tmp_path / "p"))
    path = package.component_path(str(tmp_path / "p"), "vx")
    rows = spark.read.parquet(path).where("rank <> 70").cache()
    rows.count()
    rows.write.mode("overwrite").parquet(path)
    with pytest.raises(ParticleError, match="vx: decoded"):
        engine.decompress(spark, str(tmp_path / "p"))
    with pytest.raises(ParticleError, match="is bigint, not double"):
        codec.check_decoded(spark.range(3), 3, types={"id": "double"})


def test_a_damaged_file_does_not_end_a_batch(spark, table, tmp_path):
    table.drop("place").coalesce(1).write.parquet(str(tmp_path / "in" / "b.parquet"))
    (tmp_path / "in" / "a.parquet").write_text("no table")
    for workers in (0, 1):
        with pytest.raises(ParticleError, match="a: "):
            engine.batch(spark, str(tmp_path / "in"), str(tmp_path / f"out{workers}"), "compress", workers=workers)
        kept = json.loads((tmp_path / f"out{workers}" / "batch_metrics.json").read_text())
        assert [(f["file"], f["succeeded"]) for f in kept["files"]] == [("a", False), ("b", True)] and kept["files"][0]["error"]


def test_batch(spark, table, tmp_path):
    for name in ("b", "a"):
        table.drop("place").coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    (tmp_path / "in" / "ignored.PARQUET").write_text("")
    got = engine.batch(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [f["file"] for f in got["files"]] == ["a", "b"] and got["totals"]["particles"] == 514 and report.batch_lines(got)
    assert got["totals"]["compression_ratio"] == pytest.approx(got["totals"]["original_bytes"] / got["totals"]["compressed_bytes"])
    assert engine.batch(spark, str(tmp_path / "in"), str(tmp_path / "pre"), "preprocess")["totals"]["compression_ratio"] is None
    spark.range(3).write.parquet(str(tmp_path / "in" / "c.parquet"))
    with pytest.raises(ParticleError, match="c: no column"):
        engine.batch(spark, str(tmp_path / "in"), str(tmp_path / "out2"))
    kept = json.loads((tmp_path / "out2" / "batch_metrics.json").read_text())
    assert kept["totals"]["failed"] == 1 and kept["totals"]["compression_ratio"] is None
    assert main(["roundtrip", str(tmp_path / "none"), "--output", str(tmp_path / "x"), "--batch"], spark) == 2


def test_row_ids_over_files(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t" / "k=1"))
    spark.range(100, 150).coalesce(1).write.parquet(str(tmp_path / "t" / "k=2"))
    got = P.with_row_ids(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert all(r["row_id"] == r["id"] for r in got) and len(got) == 150


def test_small_vectors(spark):
    ids = spark.createDataFrame([(k, i) for k, i in enumerate([30, 10, 30, 20, 10])], "row_id long, id long")
    perm = order.id_order(ids)
    assert [r["row_id"] for r in perm.orderBy("rank").collect()] == [1, 4, 3, 0, 2]
    gathered = order.gather(ids, perm)
    assert [r["id"] for r in gathered.orderBy("row_id").collect()] == [10, 10, 20, 30, 30]
    assert [r["id"] for r in order.scatter(gathered, perm).orderBy("row_id").collect()] == [30, 10, 30, 20, 10]
    for bad, what in (([0, 1, 1], "not a permutation"), ([0, 1, 3], "out of range")):
        with pytest.raises(ParticleError, match=what):
            order.check_permutation(spark.createDataFrame([(x,) for x in bad], "row_id long"), 3, "test")
    local = spark.createDataFrame([(k, k // 3, x) for k, x in enumerate([2, 0, 1, 1, 0])], "k long, chunk_id long, local_idx long")
    assert [r["row_id"] for r in order.to_global(local, 3).orderBy("k").collect()] == [2, 0, 1, 4, 3]
    assert [r["local_idx"] for r in order.to_local(order.to_global(local, 3).drop("local_idx"), 3).orderBy("k").collect()] == [2, 0, 1, 1, 0]
    assert [(s.start, s.values, s.chunks) for s in chunk.segments(5, 3)] == [(0, 3, 1), (3, 2, 1)]
    assert [s.chunks for s in chunk.segments(10 * 2**19, 2**19)] == [2] * 5


def test_global_rank_is_gapless(spark):
    df = spark.range(5000).selectExpr("id as row_id", "hash(id) % 50 as v")
    got = order.global_rank(df, "v", "row_id", parts=7).orderBy("v", "row_id").collect()
    assert [r["rank"] for r in got] == list(range(5000))
    assert order.global_rank(df.where("v > 1000"), "v").count() == 0


def test_alignment_failures(spark):
    make = lambda ids: spark.createDataFrame([(i, float(i)) for i in ids], "id long, x double")
    assert align.by_id(make([1, 2]), make([2, 1]), ["x"]).count() == 2
    with pytest.raises(ParticleError, match="differ"):
        align.by_id(make([1, 2]), make([1, 3]), ["x"])
    with pytest.raises(ParticleError, match="differ"):
        align.by_id(make([1, 1, 2]), make([1, 2, 2]), ["x"])
    with pytest.raises(ParticleError, match="repeat"):
        align.by_id(make([1, 1]), make([1, 1]), ["x"])


def test_batch_vectors(spark):
    schema = "succeeded boolean, particles long, original_bytes long, compressed_bytes long, wall_seconds double, timings map<string,double>"
    files = spark.createDataFrame([(True, 10, 100, 20, 4.0, {"pre": 1.0}), (True, 30, 300, 100, 6.0, {"pre": 2.0})], schema)
    t = rollup.batch_totals(files, 7.0).first()
    assert (t["particles"], t["compression_ratio"], t["file_seconds"]) == (40, 400 / 120, 10.0)
    assert [tuple(r) for r in rollup.stage_seconds(files).collect()] == [("pre", 3.0)]
    ratios = files.withColumn("r", F.col("original_bytes") / F.col("compressed_bytes"))
    assert rollup.summary(ratios, "r").first()["median"] == 4.0
    failed = files.union(spark.createDataFrame([(False, 0, 0, None, 0.0, {})], schema))
    assert rollup.batch_totals(failed, 7.0).first()["compression_ratio"] is None
    assert rollup.batch_totals(files, 0.0).first()["parallel_speedup"] == math.inf
    sizes = spark.createDataFrame([("x.parquet/part-0", 4), ("y.parquet/part-0", 8), ("z.parquet/part-0", 16)], "path string, bytes long")
    got = {r["name"]: r["compression_ratio"] for r in rollup.component_ratios(sizes, dict.fromkeys(LOGICAL, 4), 4).collect()}
    assert (got["x"], got["y"], got["z"], got["id"]) == (4.0, 2.0, 1.0, math.inf)


def test_options(tmp_path):
    for bad in ({"pos_codec": "x"}, {"pos_codec": "linear", "vel_codec": "sorted"}, {"pos_abs_eb": 1, "pos_rel_eb": 1}, {"abs_eb": -1}, {"limit": 0}, {"vel_chunk_size": 5}, {"nope": 1}, {"rel_eb": True}, {"position_scale": "x"}, {"lossless": "x"}, {"rel_eb": "x"}):
        with pytest.raises(ParticleError):
            config.from_mapping(bad)
    (tmp_path / "c.yaml").write_text("rel_eb: 1e-3\npos_codec: lattice  # comment\nvel_codec: 'delta'\n")
    got = config.from_mapping(config.load(str(tmp_path / "c.yaml")))
    assert (got.rel_eb, got.pos_codec, got.vel_codec) == (1e-3, "lattice", "delta")
    (tmp_path / "n.yaml").write_text("# options\nadvanced:\n  rel_eb: 1e-2\n\n  vel_abs_eb: null\n")
    assert config.from_mapping(config.load(str(tmp_path / "n.yaml"))).rel_eb == 1e-2
    (tmp_path / "n.json").write_text('{"advanced": {"rel_eb": 0.5}}')
    assert config.from_mapping(config.load(str(tmp_path / "n.json"))).rel_eb == 0.5
    (tmp_path / "c.json").write_text('{"vel_rel_eb": "1e-4"}')
    assert config.from_mapping(config.load(str(tmp_path / "c.json"))).vel_rel_eb == 1e-4
    assert not Settings(sort=True).sort_by_id and Settings(sort=True, pos_codec="linear").sort_by_id


def test_planning(table):
    p = engine.prepare(table, Settings(rel_eb=1e-2), row_id="place")
    for f in POSITIONS:
        assert p.bounds.positions.absolute[f] == pytest.approx(1e-2 * p.profile.positions[f].range)
    diagonal = math.sqrt(sum(p.profile.positions[f].range ** 2 for f in POSITIONS))
    assert p.bounds.position_triplet.requested == pytest.approx(1e-2 * diagonal)
    assert p.bounds.position_codec == pytest.approx(min(p.bounds.positions.absolute.values()))
    assert engine.prepare(table, Settings(abs_eb=0.5), row_id="place").bounds.velocities.absolute == dict.fromkeys(VELOCITIES, 0.5)
    assert engine.prepare(table, row_id="place").bounds.positions.relative == 1e-3
    with pytest.raises(ParticleError, match="lattice"):
        engine.prepare(table, Settings(pos_codec="lattice", pos_abs_eb=0.0), row_id="place")
    assert engine.prepare(table, Settings(limit=10), row_id="place").profile.count == 10


def test_sources(spark, table):
    with pytest.raises(ParticleError, match="particle_id"):
        P.particles(table.drop("particle_id"), row_id="place")
    with pytest.raises(ParticleError, match="vx"):
        P.particles(table.withColumn("velx", F.col("velx").cast("int")), row_id="place")
    with pytest.raises(ParticleError, match="id must"):
        P.particles(table.withColumn("particle_id", F.lit(1.0)), row_id="place")
    with pytest.raises(ParticleError, match="NaN"):
        engine.prepare(table.withColumn("posy", F.lit(float("nan"))), row_id="place")
    nested = table.select("place", F.struct("particle_id", F.struct("PosX", "posy", "posz").alias("pos")).alias("part"), "velx", "vely", "velz")
    assert P.particles(nested, row_id="place").paths["x"] == "`part`.`pos`.`PosX`"
    types = {"x": "int"}
    assert P.resolve_scale(types, {"bitwidth": 8}) == P.Scale(8.0, "auto_attr")
    assert P.resolve_scale({"x": "float"}, {"bitwidth": 8}) == P.Scale(1.0, "auto_raw")
    for mode, attributes, value in (("value", {}, None), ("value", {}, 0.0), ("attr", {}, None), ("attr", {"bitwidth": -1}, None), ("x", {}, None)):
        with pytest.raises(ParticleError):
            P.resolve_scale(types, attributes, mode, value=value)
    view = P.particles(table, row_id="place").view
    back = P.deinterleaved(P.interleaved(view)).orderBy("row_id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in view.select("row_id", *POSITIONS).orderBy("row_id").collect()]


def test_stream(spark, tmp_path):
    from quantara.operators.codec import Quantizer
    from quantara.streaming.chunks import encode_stream, windowed_error

    rows = spark.range(100).selectExpr("id", "cast(id as double) / 3 as value", "timestamp_seconds(id * 60) as ts")
    rows.write.parquet(str(tmp_path / "s"))
    q = Quantizer(0.0, 0.01)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    assert encode_stream(stream, {"value": q}).isStreaming
    query = windowed_error(stream, "value", q, "ts").writeStream.format("memory").queryName("errors").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("errors").collect()
    assert sum(r["n"] for r in got) == 100 and all(r["max_abs"] <= 0.01 + 1e-6 for r in got)
