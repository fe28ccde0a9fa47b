"""Command line: python -m quantara preprocess|compress|decompress|roundtrip PATH [options]. Exits 0, or 2 on bad input."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from quantara.fields import CODECS, ParticleError
from quantara.plans import config, engine, report
from quantara.sources import package


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quantara", description="Error-bounded packages of particle tables.")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "compress", "roundtrip", "decompress"):
        c = commands.add_parser(name)
        c.add_argument("path", help="a Parquet table, a folder of them (*.parquet), or for decompress a package")
        c.add_argument("--output", required=name != "preprocess", default="particles-out")
        c.add_argument("--force", action="store_true")
        if name == "decompress":
            continue
        c.add_argument("--config", help="options as JSON or 'name: value' lines")
        c.add_argument("--batch", action="store_true", help="PATH is a folder of tables")
        c.add_argument("--clean-raw", action="store_true", help="remove what only metrics need")
        c.add_argument("--attribute", action="append", default=[], metavar="NAME=VALUE")
        c.add_argument("--sort", action="store_true")
        for f in fields(config.Settings):
            if f.name in ("sort", "force"):
                continue
            kind = int if f.name in ("limit", "vel_chunk_size") else str if isinstance(f.default, str) else float
            c.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=kind, default=None, choices=CODECS if f.name in ("pos_codec", "vel_codec") else None)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command != "decompress":
            values = config.load(args.config) if args.config else {}
            values |= {f.name: v for f in fields(config.Settings) if (v := getattr(args, f.name, None)) not in (None, False)}
            settings = config.from_mapping(values)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("quantara").getOrCreate()
        if args.command == "decompress":
            manifest = package.read_json(spark, f"{args.path}/{package.MANIFEST}")
            engine.write_table(engine.decompress(spark, args.path), manifest, args.output, args.force)
            return 0
        pairs = (a.partition("=") for a in args.attribute)
        attributes = {k: json.loads(v) for k, _, v in pairs}
        if args.batch:
            print("\n".join(report.batch_lines(engine.batch(spark, args.path, args.output, args.command, settings, attributes))))
            return 0
        df = spark.read.parquet(args.path)
        if args.command == "roundtrip":
            print("\n".join(report.roundtrip_lines(engine.roundtrip(df, args.output, settings, clean=args.clean_raw, attributes=attributes))))
            return 0
        p = engine.prepare(df, settings, attributes=attributes)
        if args.command == "compress":
            print("ratio", report.number(engine.compress(p, args.output)["sizes"]["compression_ratio"]))
        else:
            print(json.dumps(package._plain({"count": p.profile.count, "bounds": p.bounds.as_dict()}), indent=2, sort_keys=True))
        return 0
    except (ParticleError, OSError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
