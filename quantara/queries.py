"""The registered queries of the particle engine over the driver's tables, each with its DuckDB counterpart.

Views: PV32 (embeddings, float triplets), PV64 (lineitem in file order, doubles, ids that repeat), PVFX (orders,
fixed-point positions, scale 100), EV (events, one column).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantara.fields import CODECS, LOGICAL, POSITIONS, VELOCITIES, check_codec_pair
from quantara.functions import scalar
from quantara.operators import align, chunk, codec, metrics, order, rollup, stats
from quantara.plans.bounds import tolerance
from quantara.sources import particles as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CHUNK = 4096
REL = 1e-3
LIMIT = 1000
BITS = 10
PV64_COLUMNS = {"id": "l_orderkey", "x": "l_extendedprice", "y": "l_quantity", "z": "l_tax", "vx": "l_extendedprice", "vy": "l_quantity", "vz": "l_discount"}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def pv32(spark, d) -> DataFrame:
    e = F.col("embedding")
    raw = _table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("vec_id").alias("particle_id"), *(F.get(e, k).alias(n) for k, n in enumerate(("PosX", "PosY", "PosZ", "VelX", "VelY", "VelZ"))))
    return P.particles(raw, row_id="row_id").view


def pv64(spark, d) -> DataFrame:
    rows = P.with_row_ids(_table(spark, d, "lineitem"))
    return P.particles(rows.select("row_id", *(F.col(c).alias(f) for f, c in PV64_COLUMNS.items())), row_id="row_id").view


def pvfx(spark, d) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("x"), F.col("o_custkey").alias("y"), F.col("o_orderkey").alias("z"), *(F.col("o_totalprice").alias(v) for v in VELOCITIES))
    return P.particles(rows.withColumn("id", F.col("o_orderkey")), row_id="o_orderkey").view


def ev(spark, d) -> DataFrame:
    return _table(spark, d, "events").select("event_id", "event_type", "value")


def ev_quantizer(spark, d) -> codec.Quantizer:
    low, high = ev(spark, d).agg(F.min("value"), F.max("value")).first()
    return codec.Quantizer(low, REL * (high - low))


_PV64 = "select row_number() over () - 1 as row_id, " + ", ".join(f"{c} as {f}" for f, c in PV64_COLUMNS.items()) + " from lineitem"
_PV32 = "select vec_id as row_id, vec_id as id, " + ", ".join(f"embedding[{k + 1}] as {f}" for k, f in enumerate((*POSITIONS, *VELOCITIES))) + " from embeddings"
_PVFX = "select o_orderkey as row_id, o_orderkey as id, cast(round(o_totalprice * 100) as bigint) as x, o_custkey as y, o_orderkey as z from orders"
_Q = f"s as (select min(value) as lo, {REL!r}::double * (max(value) - min(value)) as eb from events), q as (select event_id, event_type, value, lo, eb, cast(round_even((value - lo) / (2.0::double * eb), 0) as bigint) as q from events, s)"
_FIELDS = (*POSITIONS, *VELOCITIES)


def _each(template: str, fields=_FIELDS) -> str:
    return " union all ".join(template.replace("{f}", f) for f in fields)


# Sources and projections


@query(f"with p as ({_PV32}) select id, x, y, z, vx, vy, vz from p")
def schema_project(spark, d):
    return pv32(spark, d).select(*LOGICAL)


@query(f"select event_id, value from events where event_id < {LIMIT}")
def limit_prefix(spark, d):
    return ev(spark, d).where(F.col("event_id") < LIMIT).select("event_id", "value")


@query(f"with p as ({_PV32}) select count(*) as n from p where row_id < {LIMIT}")
def selected_count(spark, d):
    return spark.createDataFrame([(P.row_count(pv32(spark, d), LIMIT),)], "n long")


@query(f"with p as ({_PVFX}) select id, cast(x / 100.0::double as float) as x from p")
def scale_cast(spark, d):
    return pvfx(spark, d).select("id", scalar.narrowed(scalar.scaled(F.col("x"), 100.0)).alias("x"))


@query(f"with p as ({_PVFX}) select id, cast(round_even(cast(cast(x / 100.0::double as float) as double) * 100.0::double, 0) as bigint) as x from p")
def inverse_scale(spark, d):
    return pvfx(spark, d).select("id", scalar.unscaled(scalar.narrowed(scalar.scaled(F.col("x"), 100.0)), 100.0, "bigint").alias("x"))


@query(f"with p as ({_PV32}) " + " union all ".join(f"select row_id * 3 + {k} as pos, {f} as value from p" for k, f in enumerate(POSITIONS)))
def interleave(spark, d):
    return P.interleaved(pv32(spark, d))


@query(f"with p as ({_PV32}) select row_id, x, y, z from p")
def deinterleave(spark, d):
    return P.deinterleaved(P.interleaved(pv32(spark, d)))


# Statistics


@query(f"with p as ({_PV64}) " + _each("select '{f}' as field, min({f}) + 0.0 as min_value, max({f}) + 0.0 as max_value, max({f}) - min({f}) + 0.0 as range_value, max(abs(cast(cast({f} as float) as double) - {f})) as cast_error from p"))
def field_stats(spark, d):
    wide = pv64(spark, d).agg(*(a for f in _FIELDS for a in stats.range_columns(f, F.col(f).cast("double"))))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_min").alias("min_value"), F.col(f"{f}_max").alias("max_value"), (F.col(f"{f}_max") - F.col(f"{f}_min") + 0.0).alias("range_value"), F.col(f"{f}_cast").alias("cast_error")) for f in _FIELDS))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


@query(f"with p as ({_PVFX}) select " + ", ".join(f"min({f}) as {f}_min, max({f}) as {f}_max, max({f}) - min({f}) as {f}_range" for f in POSITIONS) + " from p")
def int_stats(spark, d):
    return stats.int_range(pvfx(spark, d), POSITIONS)


@query("with s as (select min(value) as lo, max(value) as hi from events) select event_id, round((value - lo) / (hi - lo), 12) as share from events, s")
def stats_broadcast(spark, d):
    """A one-row aggregate beside every row."""
    rows = ev(spark, d)
    one = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rows.join(F.broadcast(one)).select("event_id", F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 12).alias("share"))


@query(f"with p as ({_PV64}) select cast(count(*) * 56 as bigint) as payload_bytes, cast(count(*) * 24 as bigint) as position_bytes, cast(count(*) * 24 as bigint) as velocity_bytes, cast(count(*) * 8 as bigint) as id_bytes from p")
def payload_bytes(spark, d):
    rows = P.with_row_ids(_table(spark, d, "lineitem"))
    source = P.particles(rows.select("row_id", *(F.col(c).alias(f) for f, c in PV64_COLUMNS.items())), row_id="row_id")
    groups = {"payload": LOGICAL, "position": POSITIONS, "velocity": VELOCITIES, "id": ("id",)}
    return source.view.agg(*((F.count("*") * source.item_bytes(fs)).cast("long").alias(f"{n}_bytes") for n, fs in groups.items()))


# Orders


@query(f"with p as ({_PV64}) select row_number() over (order by id, row_id) - 1 as rank, row_id from p")
def id_sort_perm(spark, d):
    return order.id_order(pv64(spark, d))


def _ranges(view, fields):
    r = view.agg(*(a for f in fields for a in (F.min(F.col(f).cast("double")), F.max(F.col(f).cast("double"))))).first()
    return {f: (r[2 * k], r[2 * k + 1]) for k, f in enumerate(fields)}


_N = (1 << BITS) - 1
_MORTON = (
    f"p as ({_PV32}), r as (select " + ", ".join(f"min(cast({f} as double)) as {f}0, max(cast({f} as double)) as {f}1" for f in POSITIONS) + " from p), "
    + "g as (select row_id, id, " + ", ".join(f"greatest(0, least({_N}, cast(floor((cast({f} as double) - {f}0) / ({f}1 - {f}0) * {float(_N)!r}::double) as bigint))) as c{f}" for f in POSITIONS) + " from p, r), "
    + "m as (select row_id, id, cast(" + " + ".join(f"(((c{f} >> {b}) & 1) << {3 * b + k})" for b in range(BITS) for k, f in enumerate(POSITIONS)) + " as bigint) as code from g), "
    + "o as (select row_number() over (order by code, row_id) - 1 as rank, row_id, id, code from m)"
)


def _morton(spark, d):
    view = pv32(spark, d)
    return view, order.morton_order(view, POSITIONS, _ranges(view, POSITIONS), BITS)


@query(f"with {_MORTON} select row_id, code from m")
def morton_code(spark, d):
    view = pv32(spark, d)
    return order.morton_codes(view, POSITIONS, _ranges(view, POSITIONS), BITS).select("row_id", "code")


@query(f"with {_MORTON} select rank, row_id from o")
def morton_order(spark, d):
    return _morton(spark, d)[1]


@query(f"with {_MORTON} select rank as row_id, id from o")
def gather(spark, d):
    view, perm = _morton(spark, d)
    return order.gather(view.select("row_id", "id"), perm)


@query(f"with p as ({_PV32}) select row_id, id from p")
def scatter_inverse(spark, d):
    view, perm = _morton(spark, d)
    return order.scatter(order.gather(view.select("row_id", "id"), perm), perm)


@query(f"with p as ({_PV64}) select count(*) as n, cast(min(row_id) as bigint) as low, cast(max(row_id) as bigint) as high, count(distinct row_id) as distinct_n, 1 as valid from p")
def perm_validate(spark, d):
    return order.permutation_facts(order.id_order(pv64(spark, d)))


@query("select count(*) as n, cast(len(bin(count(*) - 1)) as integer) as bits from events")
def index_bits(spark, d):
    return ev(spark, d).agg(F.count("*").alias("n")).select("n", scalar.bit_width(F.col("n") - 1).alias("bits"))


# Chunks


@query(f"with p as ({_PV64}), n as (select count(*) as total from p) select cast(row_id // {CHUNK} as bigint) as chunk_id, count(*) as n, cast(least({CHUNK}, max(total) - (row_id // {CHUNK}) * {CHUNK}) as bigint) as expected, 1 as valid from p, n group by row_id // {CHUNK}")
def chunk_assign(spark, d):
    rows = pv64(spark, d)
    return chunk.chunk_facts(chunk.with_chunks(rows.select("row_id"), CHUNK), rows.count(), CHUNK)


_LOCAL = f"p as ({_PV64}), c as (select cast(row_id // {CHUNK} as bigint) as chunk_id, cast(row_id % {CHUNK} as bigint) as local_idx, x from p)"


@query(f"with {_LOCAL} select chunk_id, row_number() over (partition by chunk_id order by x, local_idx) - 1 as k, local_idx from c")
def chunk_local_order(spark, d):
    rows = chunk.with_chunks(pv64(spark, d).select("row_id", "x"), CHUNK)
    return order.local_order(rows, "x", "local_idx").select("chunk_id", "k", "local_idx")


@query(f"with {_LOCAL} select chunk_id, count(*) as n, min(local_idx) as low, max(local_idx) as high, count(distinct local_idx) as distinct_n, 1 as valid from c group by chunk_id")
def chunk_local_validate(spark, d):
    return order.local_facts(chunk.with_chunks(pv64(spark, d).select("row_id"), CHUNK))


@query(f"with {_LOCAL} select chunk_id, local_idx, chunk_id * {CHUNK} + local_idx as row_id from c")
def local_to_global(spark, d):
    rows = chunk.with_chunks(pv64(spark, d).select("row_id"), CHUNK)
    return order.to_global(order.to_local(rows.drop("local_idx"), CHUNK), CHUNK).select("chunk_id", "local_idx", "row_id")


@query(f"with p as ({_PV64}), n as (select count(*) as total from p), c as (select row_id // {CHUNK} as chunk_id, total from p, n), g as (select chunk_id, case when chunk_id = total // {CHUNK} and total % {CHUNK} > 0 then (total // {CHUNK} + 255) // 256 else chunk_id // 256 end as segment_id from c) select cast(segment_id as bigint) as segment_id, count(*) as n, count(distinct chunk_id) as chunks from g group by segment_id")
def chunk_segments(spark, d):
    rows = pv64(spark, d).select("row_id")
    return chunk.with_segments(chunk.with_chunks(rows, CHUNK), rows.count(), CHUNK).groupBy("segment_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


# Bounds


@query(f"with p as ({_PV64}) " + _each(f"select '{{f}}' as field, round({REL!r}::double * (max({{f}}) - min({{f}})), 12) as bound from p"))
def rel_bounds(spark, d):
    r = stats.profile(pv64(spark, d))
    return spark.createDataFrame([(f, round(REL * s.range, 12)) for f, s in r.fields.items()], "field string, bound double")


@query(f"with p as ({_PV32}), r as (select sqrt(" + " + ".join(f"(cast(max({f}) as double) - min({f})) * (cast(max({f}) as double) - min({f}))" for f in POSITIONS) + f") as diagonal from p) select round(diagonal, 9) as diagonal, round({REL!r}::double * diagonal, 12) as bound from r")
def vector_bound(spark, d):
    r = stats.profile(pv32(spark, d)).positions
    diagonal = sum(s.range**2 for s in r.values()) ** 0.5
    return spark.createDataFrame([(round(diagonal, 9), round(REL * diagonal, 12))], "diagonal double, bound double")


# Codecs


@query(f"with {_Q} select event_id, q from q")
def quantize_linf(spark, d):
    return ev(spark, d).select("event_id", ev_quantizer(spark, d).code(F.col("value")).alias("q"))


def _coded(spark, d):
    q = ev_quantizer(spark, d)
    return q, chunk.with_chunks(ev(spark, d).select(F.col("event_id").alias("rank"), q.code(F.col("value")).alias("q_value")), CHUNK, place="rank")


@query(f"with {_Q} select event_id, q - coalesce(lag(q) over (partition by event_id // {CHUNK} order by event_id), 0) as q from q")
def quantize_delta(spark, d):
    return codec.delta_encode(_coded(spark, d)[1], ["value"]).select(F.col("rank").alias("event_id"), F.col("q_value").alias("q"))


@query(f"with {_Q} select event_id, round(lo + q * (2.0::double * eb), 9) as value from q")
def dequantize(spark, d):
    q, rows = _coded(spark, d)
    back = codec.delta_decode(codec.delta_encode(rows, ["value"]), ["value"])
    return back.select(F.col("rank").alias("event_id"), F.round(q.value(F.col("q_value")), 9).alias("value"))


_L2_EB = 0.01
_L2 = (
    f"p as ({_PV32}), r as (select " + ", ".join(f"min(cast({f} as double)) as {f}0" for f in POSITIONS) + " from p), "
    + "c as (select row_id, " + ", ".join(f"cast({f} as double) as {f}, {f}0, cast(round_even((cast({f} as double) - {f}0) / {2 * scalar.l2_axis_bound(_L2_EB)!r}::double, 0) as bigint) as q_{f}" for f in POSITIONS) + " from p, r)"
)


def _l2(spark, d):
    view = pv32(spark, d).select("row_id", *(F.col(f).cast("double").alias(f) for f in POSITIONS))
    lows = {f: low for f, (low, _) in _ranges(view, POSITIONS).items()}
    return view, codec.triplet_quantizers("lattice", lows, 0.0, _L2_EB)


@query(f"with {_L2} select row_id, q_x, q_y, q_z from c")
def quantize_l2(spark, d):
    view, q = _l2(spark, d)
    return codec.encode(view, q).select("row_id", *(f"q_{f}" for f in POSITIONS))


@query(f"with {_L2}, e as (select " + " + ".join(f"pow(cast(cast({f}0 + q_{f} * {2 * scalar.l2_axis_bound(_L2_EB)!r}::double as float) as double) - {f}, 2)" for f in POSITIONS) + f" as sq from c) select count(*) as n, round(sqrt(max(sq)), 9) as max_l2, round(avg(sqrt(sq)), 9) as mean_l2, round(sqrt(avg(sq)), 9) as rms_l2, cast(sqrt(max(sq)) <= {_L2_EB + tolerance(_L2_EB)!r}::double as integer) as bound_ok from e")
def l2_metrics(spark, d):
    view, q = _l2(spark, d)
    pairs = align.by_place(view, codec.decode(codec.encode(view, q), q), POSITIONS)
    out = metrics.triplet_metrics(pairs, POSITIONS)
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("max_l2", "mean_l2", "rms_l2")), metrics.verdict(F.col("max_l2"), F.lit(_L2_EB)).cast("int").alias("bound_ok"))


@query(f"with c as (select cast(event_id // {CHUNK} as bigint) as chunk_id, count(*) as n, min(event_id) as low, max(event_id) - min(event_id) as span from events group by 1) select chunk_id, n, low, cast(case when span <= 0 then 0 else len(bin(span)) end as bigint) as width, cast(n * case when span <= 0 then 0 else len(bin(span)) end as bigint) as bits from c")
def lossless_width(spark, d):
    return codec.packed_width(chunk.with_chunks(ev(spark, d), CHUNK, place="event_id"), "event_id")


# Quality

_ERR = f"{_Q}, e as (select event_type, value, eb, lo + q * (2.0::double * eb) - value as e from q)"


@query(f"with {_ERR} select count(*) as n, round(max(abs(e)), 9) as max_abs, round(avg(abs(e)), 9) as mae, round(avg(e * e), 9) as mse, round(sqrt(avg(e * e)), 9) as rmse, round(20 * log10(max(value) - min(value)) - 10 * log10(avg(e * e)), 6) as psnr, cast(max(abs(e)) <= max(eb) + 1e-12 + 1e-6 * greatest(1.0, max(eb)) as integer) as bound_ok from {{e}}".replace("{e}", "e"))
def roundtrip_metrics(spark, d):
    """Flagship: plan a relative bound, quantise, restore, and measure."""
    q = ev_quantizer(spark, d)
    pairs = ev(spark, d).select(F.col("value").alias("o_value"), q.value(q.code(F.col("value"))).alias("r_value"))
    m = metrics.with_verdicts(metrics.field_metrics(pairs, ["value"]), {"value": q.bound})
    return m.select("n", *(F.round(c, 9).alias(c) for c in ("max_abs", "mae", "mse", "rmse")), F.round("psnr", 6).alias("psnr"), F.col("bound_ok").cast("int").alias("bound_ok"))


@query(
    f"with p as ({_PV64}) "
    + _each("select '{f}' as field, count(*) as n, round(max(abs(cast(cast({f} as float) as double) - {f})), 12) as max_abs, round(avg(pow(cast(cast({f} as float) as double) - {f}, 2)), 12) as mse, round(max({f}) - min({f}) + 0.0, 9) as range, round(case when max({f}) = min({f}) then 0 else sqrt(avg(pow(cast(cast({f} as float) as double) - {f}, 2))) / (max({f}) - min({f})) end, 12) as nrmse from p")
)
def metrics_unpivot(spark, d):
    """What narrowing costs each field."""
    pairs = pv64(spark, d).select(*(F.col(f).alias(f"o_{f}") for f in _FIELDS), *(scalar.narrowed(F.col(f)).cast("double").alias(f"r_{f}") for f in _FIELDS))
    m = metrics.field_metrics(pairs, _FIELDS)
    return m.select("field", "n", F.round("max_abs", 12).alias("max_abs"), F.round("mse", 12).alias("mse"), F.round("range", 9).alias("range"), F.round("nrmse", 12).alias("nrmse"))


@query(f"with p as ({_PV32}) select 1 as exact_match from p limit 1")
def exact_match_id(spark, d):
    view, perm = _morton(spark, d)
    back = order.scatter(order.gather(view, perm), perm)
    return metrics.exact_match(align.by_place(view, back, ["id"]))


@query(f"with {_Q} select event_id, round(value, 9) as o_value, round(lo + q * (2.0::double * eb), 9) as r_value from q")
def align_by_id(spark, d):
    q, rows = ev_quantizer(spark, d), ev(spark, d)
    restored = rows.select("event_id", q.value(q.code(F.col("value"))).alias("value")).repartition("event_id")
    return align.by_id(rows, restored, ["value"], id_col="event_id").select("event_id", F.round("o_value", 9).alias("o_value"), F.round("r_value", 9).alias("r_value"))


@query("select cast(count(*) filter (event_id % 10 = 0) as bigint) as only_original, cast(count(*) filter (event_id % 10 = 1) as bigint) as only_restored from events")
def align_mismatch(spark, d):
    """Ids of which each side lacks some."""
    rows = ev(spark, d)
    return align.mismatch(rows.where("event_id % 10 <> 1"), rows.where("event_id % 10 <> 0"), id_col="event_id")


@query("select count(*) as n, count(distinct l_orderkey) as distinct_n, count(*) - count(distinct l_orderkey) as duplicated from lineitem")
def duplicate_ids(spark, d):
    return align.duplicate_ids(pv64(spark, d))


@query(f"with {_ERR} select event_type, 'value' as field, round(max(abs(e)), 9) as max_abs, round(avg(e * e), 9) as mse, round(20 * log10(max(value) - min(value)) - 10 * log10(avg(e * e)), 6) as psnr, 'source_units' as units from e group by event_type")
def quality_rows(spark, d):
    """Figures of each event type, as of a batch of files."""
    q = ev_quantizer(spark, d)
    pairs = ev(spark, d).select("event_type", F.col("value").alias("o_value"), q.value(q.code(F.col("value"))).alias("r_value"))
    rows = rollup.quality_rows(metrics.field_metrics(pairs, ["value"], by=["event_type"]), by=["event_type"])
    return rows.select("event_type", "field", F.round("max_abs", 9).alias("max_abs"), F.round("mse", 9).alias("mse"), F.round("psnr", 6).alias("psnr"), "units")


# Roll-ups: lineitem's return flags play the files of a batch, its line numbers their parts

_PARTS = {1: "id.", 2: "x.", 3: "y.", 4: "z.", 5: "velocities.", 6: "velocity_order.", 7: "vx."}


def _sizes(spark, d):
    part = F.element_at(F.create_map(*(F.lit(x) for kv in _PARTS.items() for x in kv)), F.col("l_linenumber"))
    rows = _table(spark, d, "lineitem").withColumn("path", F.concat(part, F.lit("parquet")))
    return rows.groupBy("l_returnflag", "path").agg(F.count("*").alias("bytes"))


def _sized_sql(named: dict[str, tuple[tuple[str, ...], int]]) -> str:
    def one(name, prefixes, original):
        hit = " or ".join(f"l_linenumber = {k}" for k, p in _PARTS.items() if p in prefixes) or "false"
        c = f"cast(count(*) filter ({hit}) as bigint)"
        return f"select l_returnflag, '{name}' as name, cast({original} as bigint) as original_bytes, {c} as compressed_bytes, case when {c} = 0 then 'Infinity'::double else {original}::double / {c} end as compression_ratio from lineitem group by l_returnflag"

    return " union all ".join(one(n, p, o) for n, (p, o) in named.items())


_ITEMS = dict.fromkeys(LOGICAL, 4)
_ROWS = 1000


def _originals() -> dict[str, tuple[tuple[str, ...], int]]:
    whole = {"xyz": 12, "vxyz": 12}
    return {n: (p, whole.get(n, 4) * _ROWS) for n, p in rollup.COMPONENTS.items()}


@query(_sized_sql(_originals()))
def component_ratio(spark, d):
    return rollup.component_ratios(_sizes(spark, d), _ITEMS, _ROWS, by=["l_returnflag"])


@query(_sized_sql({"positions": (rollup.COMPONENTS["xyz"], 12 * _ROWS), "id": (("id.",), 4 * _ROWS), "velocities": (rollup.GROUP_PREFIXES["velocities"], 12 * _ROWS)}))
def group_ratio(spark, d):
    return rollup.group_ratios(_sizes(spark, d), _ITEMS, _ROWS, by=["l_returnflag"])


@query("select 'positions' as name, cast(12000 * count(distinct l_returnflag) as bigint) as original_bytes, cast(count(*) filter (l_linenumber in (2, 3, 4)) as bigint) as compressed_bytes, round(12000.0::double * count(distinct l_returnflag) / count(*) filter (l_linenumber in (2, 3, 4)), 9) as compression_ratio from lineitem")
def group_total(spark, d):
    totals = rollup.group_totals(rollup.group_ratios(_sizes(spark, d), _ITEMS, _ROWS, by=["l_returnflag"]).where("name = 'positions'"))
    return totals.withColumn("compression_ratio", F.round("compression_ratio", 9))


def _files(spark, d):
    """A file for each return flag."""
    rows = _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("particles"))
    return rows.select(F.lit(True).alias("succeeded"), "particles", (F.col("particles") * 56).alias("original_bytes"), (F.col("particles") * 8).alias("compressed_bytes"), (F.col("particles") / F.lit(1000.0)).alias("wall_seconds"))


@query("select count(distinct l_returnflag) as files, count(distinct l_returnflag) as succeeded, cast(0 as bigint) as failed, count(*) as particles, cast(count(*) * 56 as bigint) as original_bytes, cast(count(*) * 8 as bigint) as compressed_bytes, 7.0::double as compression_ratio, round(count(*) / 1000.0::double, 6) as file_seconds, round(count(*) / 1000.0::double / 10, 6) as parallel_speedup, round(count(*) * 56 / 1048576.0::double / 10, 6) as mib_per_second from lineitem")
def batch_totals(spark, d):
    out = rollup.batch_totals(_files(spark, d), 10.0)
    return out.withColumns({c: F.round(c, 6) for c in ("file_seconds", "parallel_speedup", "mib_per_second")})


@query("select count(distinct l_returnflag) + 1 as files, count(distinct l_returnflag) as succeeded, cast(1 as bigint) as failed, cast(null as bigint) as compressed_bytes, cast(null as double) as compression_ratio from lineitem")
def batch_incomplete(spark, d):
    """One failed file makes the batch's sizes unknown."""
    files = _files(spark, d)
    files = files.unionByName(spark.createDataFrame([(False, 0, 0, None, 0.0)], "succeeded boolean, particles long, original_bytes long, compressed_bytes long, wall_seconds double"))
    return rollup.batch_totals(files, 10.0).select("files", "succeeded", "failed", "compressed_bytes", "compression_ratio")


@query("select event_type, min(value) + 0.0 as min, round(avg(value), 9) as mean, round(median(value), 9) as median, max(value) + 0.0 as max from events group by event_type")
def batch_summary_stats(spark, d):
    out = rollup.summary(ev(spark, d), "value", by=["event_type"])
    return out.select("event_type", (F.col("min") + 0.0).alias("min"), F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"), (F.col("max") + 0.0).alias("max"))


@query("select event_type as stage, round(sum(value), 6) as seconds from events group by event_type")
def stage_sums(spark, d):
    timed = ev(spark, d).select(F.create_map("event_type", "value").alias("timings"))
    return rollup.stage_seconds(timed).withColumn("seconds", F.round("seconds", 6))


# Codec pairs

_PAIRS = "select * from (select unnest(['sorted', 'lattice', 'linear', 'delta']) as positions) cross join (select unnest(['sorted', 'lattice', 'linear', 'delta']) as velocities)"


@query(f"select positions, velocities, case when velocities = 'sorted' and positions <> 'sorted' then 0 when velocities = 'lattice' and positions not in ('sorted', 'lattice') then 0 else 1 end as legal from ({_PAIRS})")
def codec_pairs(spark, d):
    def legal(p, v):
        try:
            check_codec_pair(p, v)
        except RuntimeError:
            return 0
        return 1

    return spark.createDataFrame([(p, v, legal(p, v)) for p in CODECS for v in CODECS], "positions string, velocities string, legal int")


@query("select event_id % 4 as kind, case event_id % 4 when 0 then 'lattice' when 1 then 'delta' when 2 then 'linear' else 'sorted' end as codec, count(*) as n from events group by 1, 2")
def codec_inference(spark, d):
    """What a package holds goes before what was configured, then the default."""
    kind = (F.col("event_id") % 4).alias("kind")
    m = ev(spark, d).select(kind).withColumns({"stored": F.when(F.col("kind") == 0, "lattice"), "artifact": F.when(F.col("kind") == 1, "delta"), "configured": F.when(F.col("kind") == 2, "linear")})
    return m.select("kind", F.coalesce("stored", "artifact", "configured", F.lit("sorted")).alias("codec")).groupBy("kind", "codec").agg(F.count("*").alias("n"))


@query(f"with p as ({_PV32}) select id from p")
def package_roundtrip(spark, d):
    """A package of the embeddings' triplets is written, read back, and each row held against its bounds."""
    import uuid

    from quantara.lineage import cut, shared_dir
    from quantara.plans import engine
    from quantara.plans.config import Settings
    from quantara.sources import package

    path = f"{shared_dir(spark).rstrip('/')}/package-{uuid.uuid4().hex}"
    p = engine.prepare(pv32(spark, d), Settings(pos_codec="sorted", vel_codec="sorted", vel_chunk_size=CHUNK), row_id="row_id")
    engine.compress(p, path)
    bounds = p.targets()
    pairs = engine.aligned_rows(p, engine.decompress(spark, path), path)
    within = [F.abs(F.col(f"o_{f}").cast("double") - F.col(f"r_{f}").cast("double")) <= bounds[f] + tolerance(bounds[f]) for f in LOGICAL]
    ok = within[0]
    for w in within[1:]:
        ok = ok & w
    out = cut(pairs.where(ok).select(F.col("r_id").alias("id")))
    package.remove(spark, path)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
