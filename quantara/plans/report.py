"""Reports as text."""

from __future__ import annotations

import math


def number(value) -> str:
    """Six significant digits; inf and n/a by name."""
    if value is None:
        return "n/a"
    return str(value) if isinstance(value, float) and math.isinf(value) else f"{value:.6g}"


def component_lines(components: dict[str, dict]) -> list[str]:
    return [f"{n}: {x['original_bytes']} -> {x['compressed_bytes']} bytes, ratio {number(x['compression_ratio'])}" for n, x in components.items() if x["compressed_bytes"]]


def roundtrip_lines(report: dict) -> list[str]:
    out = [f"rows: {report['count']}", f"compression ratio: {number(report['sizes']['compression_ratio'])}"]
    for f, x in report["fields"].items():
        out.append(f"{f}: max error {number(x['max_abs'])}, bound {number(x['bound'])}, {'ok' if x['bound_ok'] else 'EXCEEDED'}, psnr {number(x['psnr'])}")
    for g, x in report["vectors"].items():
        out.append(f"{g}: max distance {number(x['max_l2'])}, bound {number(x['bound'])}, {'ok' if x['bound_ok'] else 'EXCEEDED'}")
    return out + component_lines(report["components"])


def batch_lines(report: dict) -> list[str]:
    t = report["totals"]
    out = [f"files: {t['files']} ({t['failed']} failed), rows: {t['particles']}", f"compression ratio: {number(t['compression_ratio'])}", f"throughput: {number(t['mib_per_second'])} MiB/s, speed-up {number(t['parallel_speedup'])}"]
    out += [f"{g}: ratio {number(x['compression_ratio'])}" for g, x in report["field_groups"].items()]
    out += [f"{s}: {number(v)} s" for s, v in report["stage_seconds"].items()]
    for f in report["files"]:
        out.append(f"{f['file']}: " + (f"{number(f['wall_seconds'])} s" if f["succeeded"] else f"failed, {f['error']}"))
    return out
