"""Writers: CSV tables, manifests, labels, pictures, and publication after audits."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.config import BANDS, DatasetConfig
from chirplake.functions import scalars as S
from chirplake.functions import qscan, spectral
from chirplake.operators import arrays as A
from chirplake.operators import audits
from chirplake.operators.scratch import saved
from chirplake.ship import ship


def as_csv(table: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the fields as text: six places for numbers, empty for what is missing, lists joined by semicolons."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    out = []
    for name in fields:
        kind = kinds.get(name)
        if kind is None:
            value = F.lit("")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            value = S.fmt6(F.col(name))
        elif isinstance(kind, T.ArrayType):
            value = F.array_join(F.coalesce(name, F.array().cast(kind)), ";")
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(value.alias(name))
    return table.select(*out)


def write_csv(table: DataFrame, fields: list[str], path: str) -> None:
    as_csv(table, fields).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def label_lines(metadata: DataFrame, duration: float) -> DataFrame:
    """split, detector, sample_id, text of each label file; samples without a box have an empty one."""
    lines = F.transform("boxes", lambda b: S.yolo_line(S.yolo(b, duration)))
    return metadata.select("split", "detector", "sample_id", F.concat(F.array_join(lines, "\n"), F.when(F.size("boxes") > 0, "\n").otherwise("")).alias("text"))


def write_files(rows: DataFrame, root: str, tree: str, ending: str, column: str) -> DataFrame:
    """Write a column as files {root}/{tree}/{split}/{detector}/{sample_id}{ending}; a table of paths and sizes.

    For exports to a file system that all executors mount; tables are the way to
    keep large results.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            paths, sizes = [], []
            for r in f.itertuples():
                data = getattr(r, column)
                data = data.encode() if isinstance(data, str) else bytes(data)
                path = Path(root, tree, r.split, r.detector, f"{r.sample_id}{ending}")
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(data)
                paths.append(str(path))
                sizes.append(len(data))
            yield pd.DataFrame({"path": paths, "bytes": sizes})

    return rows.select("split", "detector", "sample_id", column).mapInPandas(run, "path string, bytes bigint")


def picture(energy: Column) -> Column:
    """A PNG of each energy map, in its own size."""

    ship(SparkSession.active())

    @F.pandas_udf(T.BinaryType())
    def run(maps: pd.Series) -> pd.Series:
        return maps.map(lambda e: None if e is None else spectral.png(spectral.energy_picture(np.stack([np.asarray(r, dtype=float) for r in e]))))

    return run(energy)


def boxed_picture(energy: Column, boxes: Column, duration: float = 4.0) -> Column:
    """A PNG of each energy map with its boxes (array of the box struct): chirps in solid, glitches in dashed lines."""
    ship(SparkSession.active())
    corners = F.transform(boxes, lambda b: F.array(b["class_id"].cast("double"), *[S.yolo(b, duration)[k] for k in ("cx", "cy", "w", "h")]))

    @F.pandas_udf(T.BinaryType())
    def run(maps: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for grid, own in zip(maps, marks, strict=True):
            if grid is None:
                out.append(None)
                continue
            rgb = spectral.energy_picture(np.stack([np.asarray(r, dtype=float) for r in grid]))
            h, w, _ = rgb.shape
            for kind, x, y, bw, bh in own if own is not None else ():
                rgb = spectral.draw_box(rgb, ((x - bw / 2) * w, (y - bh / 2) * h, (x + bw / 2) * w, (y + bh / 2) * h), (255, 64, 64) if kind == 0 else (64, 255, 255), dash=0 if kind == 0 else 3)
            out.append(spectral.png(rgb))
        return pd.Series(out)

    return run(energy, corners)


def contact_sheets(pictures: DataFrame, key: str, columns: int = 4) -> DataFrame:
    """One sheet per key of energy maps of one size (column energy); sample the rows per key first, as a sheet has some dozens."""
    ship(pictures.sparkSession)
    schema = pictures.select(key).schema.add("sheet", "binary")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drawn = [spectral.energy_picture(np.stack([np.asarray(r, dtype=float) for r in e])) for e in pdf["energy"]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "sheet": [spectral.png(spectral.contact_sheet(drawn, columns))]})

    return pictures.select(key, "energy").groupBy(key).applyInPandas(run, schema)


def outlined(content: Column, boxes: Column) -> Column:
    """PNG pictures with their boxes (array of class_id, cx, cy, w, h): chirps in dashed red, glitches in solid green; one without boxes as it is."""
    ship(SparkSession.active())
    marks = F.transform(boxes, lambda b: F.array(b["class_id"].cast("double"), b["cx"], b["cy"], b["w"], b["h"]))

    @F.pandas_udf(T.BinaryType())
    def run(pictures: pd.Series, every: pd.Series) -> pd.Series:
        out = []
        for data, own in zip(pictures, every, strict=True):
            if data is None or own is None or not len(own):
                out.append(data)
                continue
            rgb = spectral.read_png(bytes(data))
            h, w, _ = rgb.shape
            for kind, x, y, bw, bh in sorted(own, key=lambda b: -b[0]):  # glitches first
                rgb = spectral.draw_box(rgb, ((x - bw / 2) * w, (y - bh / 2) * h, (x + bw / 2) * w, (y + bh / 2) * h), (255, 64, 64) if kind == 0 else (64, 255, 64), width=2, dash=9 if kind == 0 else 0)
            out.append(spectral.png(rgb))
        return pd.Series(out)

    return run(content, marks)


def picture_sheets(pictures: DataFrame, key: str, columns: int = 4, side: int = 320) -> DataFrame:
    """One sheet per key of PNG pictures (columns sample_id, png) at one size, in order of sample_id; choose a few rows per key first."""
    ship(pictures.sparkSession)
    schema = pictures.select(key).schema.add("sheet", "binary")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shown = [spectral.resized(spectral.read_png(bytes(p)), side) for p in pdf.sort_values("sample_id")["png"]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "sheet": [spectral.png(spectral.contact_sheet(shown, columns, 14))]})

    return pictures.groupBy(key).applyInPandas(run, schema)


def labels_off(stated: Column, boxes: Column, tolerance: float) -> Column:
    """Whether a sample's chirp labels (boxes of class 0) and the box that its metadata state differ."""
    chirps = F.filter(boxes, lambda b: b["class_id"] == 0)
    return F.when(stated.isNull(), F.size(chirps) > 0).otherwise(A.box_mismatch(stated, chirps, tolerance))


def pedestal(series: Column, start: Column, end: Column, config: DatasetConfig, above: float = 400.0) -> Column:
    """Mean energy between start and end over that outside, in the rows from ``above`` Hz up; null where there is none outside."""
    ship(SparkSession.active())

    @F.pandas_udf(T.DoubleType())
    def run(every: pd.Series, begin: pd.Series, stop: pd.Series) -> pd.Series:
        freqs, times = spectral.row_frequencies(config.image_height), np.linspace(0, config.duration, config.image_width)
        out = []
        for x, a, b in zip(every, begin, stop, strict=True):
            high = qscan.energy_map(np.asarray(x, dtype=float), config)[freqs >= above]
            inside = (times >= a) & (times <= b)
            outside = float(high[:, ~inside].mean()) if (~inside).any() else 0.0
            out.append(float(high[:, inside].mean()) / outside if outside > 0 and inside.any() else None)
        return pd.Series(out, dtype=float)

    return run(series, start, end)


def strain_file(strain: Column) -> Column:
    """The bytes of a .npy file of 32-bit floats."""

    def one(x) -> bytes | None:
        if x is None:
            return None
        out = io.BytesIO()
        np.save(out, np.asarray(x, dtype=np.float32))
        return out.getvalue()

    ship(SparkSession.active())

    @F.pandas_udf(T.BinaryType())
    def run(series: pd.Series) -> pd.Series:
        return series.map(one)

    return run(strain)


def write_manifest(metadata: DataFrame, path: str, assignment: DataFrame | None = None) -> None:
    """The source-group manifest of a dataset as folders of JSON lines: a summary per split, a line per use and per group of it, and the assignment of groups.

    All of them are written by the tasks that have the rows.
    """
    rows = audits.glitch_rows(metadata).select("split", "glitch_id", S.glitch_group(F.col("glitch_source_group"), F.col("detector"), F.col("glitch_gps")).alias("grp"))
    parts = {"splits": audits.manifest(metadata), "glitch_uses": rows.groupBy("split", "glitch_id").agg(F.count("*").alias("uses")), "source_groups": rows.where("grp is not null").select("split", "grp").distinct()}
    if assignment is not None:
        parts["assignment"] = assignment.select("grp", "split")
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{path}/{name}")


def config_json(config: DatasetConfig, pool: bytes | None = None, commit: str = "") -> str:
    """The configuration with the pool's checksum and the code's commit."""
    return json.dumps({**asdict(config), "pool_sha256": hashlib.sha256(pool).hexdigest() if pool is not None else None, "code_commit": commit}, indent=2, sort_keys=True)


#: Tasks of a dataset: inputs, labels and metrics (fixed values).
TASKS = {
    "single_detector_detection": (["qtransform_normalized/{split}/{detector}/{sample_id}.png"], ["labels_yolo/{split}/{detector}/{sample_id}.txt"], ["mAP50", "mAP50-95", "precision", "recall"]),
    "cross_detector_matching": (["anchor_sample_id", "candidate_sample_id", "qtransform_normalized images"], ["pair_metadata.csv"], ["pair_matching_accuracy", "pair_matching_AUC", "pair_matching_F1", "false_positive_rate", "false_negative_rate"]),
    "coherent_event_detection": (["all detector samples sharing an event_id", "event_metadata.csv"], ["event_metadata.csv"], ["event_level_precision", "event_level_recall", "event_level_F1", "event_false_positive_rate"]),
    "low_snr_glitch_rejection": (["qtransform_normalized images", "metadata.csv", "pair_metadata.csv"], ["metadata.csv"], ["low_SNR_recall", "glitch_rejection_rate", "event_level_AUC", "calibration_error"]),
}


def protocols_yaml(config: DatasetConfig) -> str:
    """Tasks of the dataset, the frequency axis they share (its true values) and the leakage rules."""
    lines = ["split_key: event_id", "tasks:"]
    for name, (inputs, labels, metrics) in TASKS.items():
        lines.append(f"  {name}:")
        for kind, values in (("inputs", inputs), ("labels", labels), ("metrics", metrics)):
            lines += [f"    {kind}:", *(f"      - {v}" for v in values)]
    axis = f"fixed_{config.freq_scale}_{config.freq_low:g}_{config.freq_high:g}_hz"
    lines += ["frequency_coordinate_rule:", f"  qtransform_window: {axis}", f"  frange_low: {config.freq_low:g}", f"  frange_high: {config.freq_high:g}", f"  frequency_axis_scale: {config.freq_scale}"]
    lines += ["  per_type_insertion_bands:", *(f"    {k}: [{lo:g}, {hi:g}]" for k, (lo, hi) in BANDS.items())]
    rules = ("same_event", "same_chirp", "positive_pair", "negative_pair")
    return "\n".join([*lines, "data_leakage_rule:", "  split_unit: event_id", *(f"  forbid_{r}_across_splits: true" for r in rules)]) + "\n"


def data_yaml(config: DatasetConfig, root: str) -> str:
    return "\n".join([f"path: {root}", *(f"{s}: qtransform_normalized/{s}" for s in config.ratios), "nc: 2", "names: ['chirp', 'glitch']"]) + "\n"


def publish(metadata: DataFrame, pairs: dict[str, DataFrame], root: str, fields: dict[str, list[str]]) -> DataFrame:
    """Write to a staging folder, audit what was written, and only then move it into place and mark it complete."""
    spark = metadata.sparkSession
    staging = f"{root.rstrip('/')}.staging"
    tables = {"metadata": metadata, **pairs}
    for name, table in tables.items():
        table.drop("boxes").write.mode("overwrite").parquet(f"{staging}/{name}")
    read = {n: spark.read.parquet(f"{staging}/{n}") for n in tables}
    report = saved(audits.rollup(read["metadata"], read.get("positives"), read.get("negatives"), read.get("pairs")), "audit")
    audits.require(report)
    for name, names in fields.items():
        write_csv(read[name], names, f"{staging}/{name}_csv")
    report.write.mode("overwrite").parquet(f"{staging}/audit")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.create(path(f"{staging}/_COMPLETE")).close()
    # An older dataset steps aside and goes only when the new one has its name.
    before = path(f"{root.rstrip('/')}.before")
    if system.exists(path(root)):
        system.delete(before, True)
        if not system.rename(path(root), before):
            raise OSError(f"{root} could not be moved aside")
    if not system.rename(path(staging), path(root)):
        if system.exists(before):
            system.rename(before, path(root))
        raise OSError(f"{staging} could not be moved to {root}")
    system.delete(before, True)
    return spark.read.parquet(f"{root}/audit")
