"""Command line: pool, subset, prefetch-glitches, prefetch-offsource, build, audit, qa, boxes, sheets."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.config import DEFAULT, EVENT_FIELDS, METADATA_FIELDS, SPLITS, DatasetConfig
from chirplake.functions import draws
from chirplake.functions import scalars as S
from chirplake.operators import audits, groups, pairs, segments, synthesis
from chirplake.operators.scratch import saved
from chirplake.sources import catalog, sinks

#: Settings that are ranges by name; they come from --settings.
_NESTED = ("ratios", "bbh_bins", "bns_bins", "bin_weights")


def _add_settings(p: argparse.ArgumentParser) -> None:
    """A flag for every plain setting of a build, and a JSON file for all of them."""
    p.add_argument("--settings", help="JSON file of settings; flags win over it")
    p.add_argument("--image-size", type=int, help="height and width of the pictures")
    p.add_argument("--ratios", nargs=len(SPLITS), type=float, metavar=tuple(s.upper() for s in SPLITS))
    for f in dataclasses.fields(DatasetConfig):
        if f.name in _NESTED:
            continue
        flag, value = "--" + f.name.replace("_", "-"), getattr(DEFAULT, f.name)
        if isinstance(value, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif isinstance(value, tuple):
            p.add_argument(flag, nargs="+", type=type(value[0]), default=None)
        else:
            p.add_argument(flag, type=type(value), default=None)


def settings(args: argparse.Namespace) -> DatasetConfig:
    given = json.loads(Path(args.settings).read_text()) if args.settings else {}
    for f in dataclasses.fields(DatasetConfig):
        if f.name not in _NESTED and (value := getattr(args, f.name)) is not None:
            given[f.name] = tuple(value) if isinstance(value, list) else value
    if args.image_size:
        given["image_height"] = given["image_width"] = args.image_size
    if args.ratios:
        given["ratios"] = dict(zip(SPLITS, args.ratios, strict=True))
    return DatasetConfig(**given)


def _add_segments(p: argparse.ArgumentParser, needed: bool) -> None:
    p.add_argument("--pool", required=needed)
    p.add_argument("--cache", required=needed, help="folder of segments; its keys that are not to be had are beside it")
    p.add_argument("--fetcher", help="package.module:function(ifo, gps, rate, halfwin) of an archive")
    p.add_argument("--retries", type=int, default=2)


def fetcher(name: str | None) -> catalog.Fetcher | None:
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _listed(cache: str) -> str:
    return f"{cache.rstrip('/')}.unavailable"


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="chirplake")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pool", help="catalog files to a pool")
    p.add_argument("--from-file", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--ifos", nargs="+", default=["H1", "L1"])
    p.add_argument("--labels", nargs="*", default=[])
    p.add_argument("--min-confidence", type=float, default=0.9)
    p.add_argument("--per-class", type=int, default=300)
    p = sub.add_parser("subset", help="few source files that cover a pool")
    p.add_argument("--pool", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--per-detector", type=int, required=True)
    for name, said in (("prefetch-glitches", "fetch a pool's segments into a cache"), ("prefetch-offsource", "fetch whole files and cut their off-source grid into a cache")):
        p = sub.add_parser(name, help=said)
        _add_segments(p, True)
        p.add_argument("--detectors", nargs="+", default=list(DEFAULT.detectors))
        p.add_argument("--sample-rate", type=int, default=DEFAULT.sample_rate)
        p.add_argument("--halfwin", type=float, default=DEFAULT.halfwin)
        p.add_argument("--pause", type=float, default=0.0, help="seconds before a second attempt; doubled for each one after")
        p.add_argument(*(("--limit",) if name == "prefetch-glitches" else ("--per-file",)), type=int, default=None)
    p = sub.add_parser("build", help="make samples, pair, audit and publish a dataset")
    p.add_argument("--out", required=True)
    p.add_argument("--files", action="store_true", help="also write pictures, strain and label files")
    _add_settings(p)
    _add_segments(p, False)
    p = sub.add_parser("audit", help="check a metadata file and, beside it, pairs")
    p.add_argument("--metadata", required=True)
    for name in ("positives", "negatives", "pairs"):
        p.add_argument(f"--{name}", help="Parquet folder")
    p = sub.add_parser("qa", help="boxes and pedestals of real glitches")
    _add_segments(p, True)
    p.add_argument("--n", type=int, default=12)
    _add_settings(p)
    p = sub.add_parser("boxes", help="copies of a dataset's pictures with their boxes")
    p.add_argument("--dataset", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--splits", nargs="*")
    p.add_argument("--detectors", nargs="*")
    p = sub.add_parser("sheets", help="contact sheets per class, and samples whose label files are off")
    p.add_argument("--dataset", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--split", default="test", choices=[*SPLITS, "all"])
    p.add_argument("--per-class", type=int, default=4)
    p.add_argument("--sample-ids", nargs="*")
    p.add_argument("--tol", type=float, default=0.01)
    p.add_argument("--seed", type=int, default=0)
    return top.parse_args(argv)


def samples_for_pairs(metadata: DataFrame) -> DataFrame:
    """The columns that pairing reads, from a sample table."""
    return metadata.select(
        "sample_id", "event_id", "chirp_id", "split", "detector", "global_class", "has_chirp", "has_glitch", "snr_bin", "injection_time",
        F.col("label_frange_low").alias("label_low"), F.col("label_frange_high").alias("label_high"),
        (F.regexp_extract("event_id", r"(\d+)$", 1).cast("bigint") * 2 + (F.col("detector") == "L1").cast("int")).alias("ord"),
    )


def pool(spark: SparkSession, args: argparse.Namespace) -> int:
    raw = catalog.as_pool(catalog.read_text_tables(spark, args.from_file))
    kept = groups.capped(groups.confident(raw, F.col("confidence"), args.min_confidence, tuple(args.ifos), tuple(args.labels)), ["ifo", "label"], [F.col("arrival")], args.per_class)
    if kept.isEmpty():
        raise catalog.CatalogError("no row is left")
    sinks.write_csv(kept, list(catalog.POOL_FIELDS), args.out)
    kept.groupBy("ifo", "label").count().orderBy("ifo", "label").show(100, False)
    return 0


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grp", S.source_group(F.col("ifo"), F.col("gps"))).withColumn("fid", F.floor(F.col("gps") / 4096).cast("bigint"))


def subset(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = _grouped(catalog.read_pool(spark, args.pool).withColumn("ord", catalog.arrival_text(F.col("arrival"))))
    chosen = groups.subset(rows, args.per_detector)
    sinks.write_csv(chosen.orderBy("ifo", "gps"), list(catalog.POOL_FIELDS), args.out)
    chosen.groupBy("ifo").agg(F.count("*").alias("rows"), F.countDistinct("fid").alias("files")).show()
    return 0


def _fetch(args: argparse.Namespace) -> catalog.Fetcher:
    found = fetcher(args.fetcher)
    if found is None:
        raise SystemExit("there is no archive without --fetcher package.module:function")
    return found


def prefetch_glitches(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = catalog.read_pool(spark, args.pool, tuple(args.detectors))
    catalog.prefetch(rows, args.cache, _listed(args.cache), _fetch(args), args.sample_rate, args.halfwin, args.retries, args.limit, args.pause).orderBy("ifo", "outcome").show(100, False)
    return 0


def prefetch_offsource(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = _grouped(catalog.read_pool(spark, args.pool, tuple(args.detectors)))
    config = dataclasses.replace(DEFAULT, halfwin=args.halfwin)
    got = saved(catalog.prefetch_offsource(rows, args.cache, _listed(args.cache), _fetch(args), args.sample_rate, config, args.per_file, args.retries, args.pause), "prefetched")
    got.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("segments").alias("segments")).orderBy("outcome").show()
    got.where("outcome = 'failed'").orderBy("grp").show(100, False)
    return 0


def _segments(spark: SparkSession, args: argparse.Namespace, detectors: tuple[str, ...]) -> segments.Segments | None:
    if args.pool is None:
        return None
    return segments.Segments(catalog.read_pool(spark, args.pool, detectors), args.cache, _listed(args.cache), fetcher(args.fetcher), args.retries)


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    config = settings(args)
    numbers = spark.range(config.num_events).withColumnRenamed("id", "num")
    made = saved(synthesis.made_samples(numbers, config, _segments(spark, args, config.detectors), arrays=args.files), "made")
    metadata = saved(synthesis.metadata_table(made, config), "metadata")
    s = samples_for_pairs(metadata)
    allowed = {"glitch": config.glitch_negatives, "noise": config.noise_negatives, "delay": config.delay_negatives}
    positives, negatives = pairs.positive_pairs(s), saved(pairs.negative_pairs(s, config.negatives_per_positive, config.hard_fraction, config.max_physical_delay, **allowed), "negatives")
    tables = {"positives": positives, "negatives": negatives, "pairs": pairs.combined_pairs(s, positives, negatives, config.max_physical_delay), "events": synthesis.event_table(metadata)}
    report = sinks.publish(metadata, tables, args.out, {"metadata": METADATA_FIELDS, "events": EVENT_FIELDS})
    sinks.write_manifest(metadata, f"{args.out}/manifest")
    if args.files:
        files = made.select("split", "detector", "sample_id", sinks.picture(F.col("energy")).alias("png"), sinks.strain_file(F.col("strain")).alias("npy"))
        sinks.write_files(files, args.out, "qtransform_normalized", ".png", "png").count()
        sinks.write_files(files, args.out, "raw_series", ".npy", "npy").count()
        sinks.write_files(sinks.label_lines(metadata, config.duration), args.out, "labels_yolo", ".txt", "text").count()
        root = Path(args.out)
        for name, text in (("gw_data.yaml", sinks.data_yaml(config, args.out)), ("task_protocols.yaml", sinks.protocols_yaml(config)), ("dataset_config.json", sinks.config_json(config, Path(args.pool).read_bytes() if args.pool and Path(args.pool).is_file() else None))):
            (root / name).write_text(text)
    report.orderBy("place").show(20, False)
    return 0


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda path: spark.read.parquet(path) if path else None
    report = audits.rollup(catalog.read_metadata(spark, args.metadata), read(args.positives), read(args.negatives), read(args.pairs)).orderBy("place")
    report.show(20, False)
    return int(report.where("status = 'FAIL'").count() > 0)


def qa(spark: SparkSession, args: argparse.Namespace) -> int:
    """Glitches as a build would draw them: box, and mean energy inside the glitch's time over that outside, from 400 Hz up."""
    config = settings(args)
    source = _segments(spark, args, config.detectors)
    wanted = spark.range(args.n).select(F.format_string("qa_%06d", "id").alias("sample_id"), F.lit("all").alias("split"), F.element_at(F.array(*map(F.lit, config.detectors)), (F.col("id") % len(config.detectors) + 1).cast("int")).alias("ifo"))
    drawn = segments.acquired(wanted, _grouped(source.pool).withColumn("split", F.lit("all")), "glitch", config.glitch_attempts, segments.judge_glitch, source, config)
    out = drawn.join(wanted, "sample_id").select("sample_id", "ifo", "base_gps", "base_label", "base_start", "base_end", "base_low", "base_high", sinks.pedestal(F.col("base"), F.col("base_start"), F.col("base_end"), config).alias("pedestal_400"))
    out.orderBy("sample_id").show(args.n, False)
    return 0


def boxes(spark: SparkSession, args: argparse.Namespace) -> int:
    shown = catalog.labelled(catalog.read_pictures(spark, f"{args.dataset}/qtransform_normalized"), catalog.read_labels(spark, f"{args.dataset}/labels_yolo", lenient=True))
    for column, names in (("split", args.splits), ("detector", args.detectors)):
        if names:
            shown = shown.where(F.col(column).isin(*names))
    done = shown.select("split", "detector", "sample_id", F.size("boxes").alias("n"), sinks.outlined(F.col("content"), F.col("boxes")).alias("png"))
    written = sinks.write_files(done, args.out, ".", ".png", "png")
    print(f"{written.count()} pictures, {shown.where(F.size('boxes') > 0).count()} with boxes")
    return 0


def sheets(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = catalog.read_metadata(spark, f"{args.dataset}/metadata_csv")
    if args.sample_ids:
        rows = rows.where(F.col("sample_id").isin(*args.sample_ids))
    else:
        rows = rows if args.split == "all" else rows.where(F.col("split") == args.split)
        rows = groups.capped(rows.withColumn("gps", F.lit(0.0)).withColumn("__h", draws.rank_hash("viz", F.col("sample_id"), seed=args.seed)), ["global_class"], [F.col("__h"), F.col("sample_id")], args.per_class)
    keys = ["split", "detector", "sample_id"]
    stated = S.metadata_box(F.col("has_chirp"), *[S.strict_double(F.col(f"chirp_yolo_{k}")) for k in ("cx", "cy", "w", "h")])
    shown = rows.select(*keys, "global_class", stated.alias("stated")).join(catalog.labelled(catalog.read_pictures(spark, f"{args.dataset}/qtransform_normalized"), catalog.read_labels(spark, f"{args.dataset}/labels_yolo", lenient=True)), keys)
    shown = saved(shown.withColumn("off", sinks.labels_off(F.col("stated"), F.col("boxes"), args.tol)), "shown")
    if shown.isEmpty():
        raise SystemExit("no samples selected")
    made = sinks.picture_sheets(shown.select("global_class", "sample_id", sinks.outlined(F.col("content"), F.col("boxes")).alias("png")), "global_class")
    sinks.write_files(made.select(F.lit("sheets").alias("split"), F.lit(args.split).alias("detector"), F.col("global_class").alias("sample_id"), "sheet"), args.out, ".", ".png", "sheet").count()
    off = shown.where("off").select("sample_id")
    print(audits.offenders(off) if not off.isEmpty() else "all label files agree with the metadata")
    return 0


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {
    "pool": pool, "subset": subset, "prefetch-glitches": prefetch_glitches, "prefetch-offsource": prefetch_offsource, "build": build, "audit": audit, "qa": qa, "boxes": boxes, "sheets": sheets,
}


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"chirplake-{args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
