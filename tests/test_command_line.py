"""Commands on a small dataset: files, viewers, audits of pairs, and a build on segments of a made-up archive."""

import sys

import numpy as np
import pytest

from chirplake import __main__ as cli
from chirplake.functions import spectral

ARCHIVE = """
import numpy as np

def fetch(ifo, gps, rate, halfwin):
    n = round(2 * halfwin * rate)
    x = np.random.default_rng(int(gps * 10) % 2**32).standard_normal(n)
    t = np.arange(n) / rate - halfwin
    if round(gps % 4096) in (100, 900):
        x += 60 * np.exp(-((t / 0.05) ** 2)) * np.cos(2 * np.pi * 80 * t)
    return x.tolist()
"""


@pytest.fixture
def archive(spark, tmp_path, monkeypatch):
    path = tmp_path / "made_up_archive.py"
    path.write_text(ARCHIVE)
    spark.sparkContext.addPyFile(str(path))
    monkeypatch.syspath_prepend(str(tmp_path))
    yield "made_up_archive:fetch"
    sys.modules.pop("made_up_archive", None)


def test_a_dataset_with_its_files(spark, tmp_path, capsys):
    out = str(tmp_path / "data")
    assert cli.main(["build", "--out", out, "--num-events", "8", "--sample-rate", "2048", "--image-size", "48", "--files", "--no-delay-negatives", "--negatives-per-positive", "2", "--ratios", "0.5", "0.25", "0.25"]) == 0
    names = {p.stem for p in (tmp_path / "data/qtransform_normalized").rglob("*.png")}
    assert len(names) == 16 == len(list((tmp_path / "data/raw_series").rglob("*.npy"))) and names == {p.stem for p in (tmp_path / "data/labels_yolo").rglob("*.txt")}
    assert np.load(next((tmp_path / "data/raw_series").rglob("*.npy"))).shape == (8192,) and (tmp_path / "data/gw_data.yaml").exists() and (tmp_path / "data/dataset_config.json").exists()
    assert spark.read.parquet(f"{out}/negatives").where("negative_type = 'invalid_delay_same_chirp'").count() == 0
    assert spark.read.json(f"{out}/manifest/splits").count() > 0
    assert cli.main(["audit", "--metadata", f"{out}/metadata_csv", *[x for n in ("positives", "negatives", "pairs") for x in (f"--{n}", f"{out}/{n}")]]) == 0
    assert "combined_pair_split" in capsys.readouterr().out
    assert cli.main(["boxes", "--dataset", out, "--out", str(tmp_path / "boxed"), "--splits", "train"]) == 0
    boxed = list((tmp_path / "boxed").rglob("*.png"))
    assert boxed and all(spectral.read_png(p.read_bytes()).shape == (48, 48, 3) for p in boxed) and {p.parts[-3] for p in boxed} == {"train"}
    assert cli.main(["sheets", "--dataset", out, "--out", str(tmp_path / "sheets"), "--split", "all", "--per-class", "2"]) == 0
    assert list((tmp_path / "sheets").rglob("*.png")) and "agree" in capsys.readouterr().out
    label = next(p for p in (tmp_path / "data/labels_yolo").rglob("*.txt") if p.read_text().rstrip().split("\n")[-1].startswith("0 "))
    label.write_text("0 0.1 0.1 0.1 0.1\n")
    assert cli.main(["sheets", "--dataset", out, "--out", str(tmp_path / "again"), "--sample-ids", label.stem]) == 0
    assert "1 offenders" in capsys.readouterr().out


def test_a_build_from_a_prefetched_cache(spark, tmp_path, archive, capsys):
    rows = [f"{(first + i) * 4096 + at},{ifo},Blip,12,0.5" for ifo, first in (("H1", 274960), ("L1", 275100)) for i in range(6) for at in (100, 900)]
    (tmp_path / "pool.csv").write_text("\n".join(["gps,ifo,label,snr,duration", *rows]) + "\n")
    where = ["--pool", str(tmp_path / "pool.csv"), "--cache", str(tmp_path / "cache")]
    with pytest.raises(SystemExit):
        cli.main(["prefetch-glitches", *where])
    assert cli.main(["prefetch-glitches", *where, "--fetcher", archive, "--sample-rate", "2048"]) == 0
    assert cli.main(["prefetch-offsource", *where, "--fetcher", archive, "--sample-rate", "2048", "--per-file", "4"]) == 0
    assert "fetched" in capsys.readouterr().out
    settings = ["--sample-rate", "2048", "--image-size", "64", "--noise-source", "gwosc", "--glitch-source", "gwosc", "--veto-max-pixels", "60"]
    assert cli.main(["build", "--out", str(tmp_path / "data"), "--num-events", "6", *settings, *where]) == 0
    m = spark.read.parquet(str(tmp_path / "data/metadata"))
    assert m.count() == 12 and {r[0] for r in m.select("background_source").distinct().collect()} == {"gwosc"}
    assert cli.main(["qa", "--n", "3", *settings, *where]) == 0
    assert "pedestal_400" in capsys.readouterr().out


def test_pictures_of_other_writers():
    """Each filter of the format, in three kinds of pixels."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    for planes, kind in ((1, 0), (3, 2), (4, 6)):
        rgb = rng.integers(0, 256, (10, 7, planes)).astype(np.uint8)
        lines = []
        for y in range(10):
            line, above = rgb[y].astype(int), rgb[y - 1].astype(int) if y else np.zeros((7, planes), int)
            left, corner = np.vstack([np.zeros((1, planes), int), line[:-1]]), np.vstack([np.zeros((1, planes), int), above[:-1]])
            p = left + above - corner
            a, b, c = abs(p - left), abs(p - above), abs(p - corner)
            guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][y % 5]
            lines.append(bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        assert (spectral.read_png(data) == (np.repeat(rgb, 3, axis=2) if planes == 1 else rgb[:, :, :3])).all()
    with pytest.raises(ValueError):
        spectral.read_png(b"\x89PNG nothing")


def test_an_older_dataset_stays_until_the_new_one_is_there(spark, tmp_path):
    from chirplake.config import DatasetConfig
    from chirplake.operators import audits, synthesis
    from chirplake.sources import sinks
    from pyspark.sql import functions as F

    config = DatasetConfig(num_events=4, sample_rate=2048, image_width=24, image_height=24)
    m = synthesis.build_samples(spark.range(4).withColumnRenamed("id", "num"), config).cache()
    for _ in range(2):
        sinks.publish(m, {}, str(tmp_path / "d"), {})
    assert (tmp_path / "d/_COMPLETE").exists() and not (tmp_path / "d.before").exists() and not (tmp_path / "d.staging").exists()
    with pytest.raises(audits.AuditError):
        sinks.publish(m.withColumn("split", F.when(F.col("detector") == "H1", "train").otherwise("val")), {}, str(tmp_path / "d"), {})
    assert spark.read.parquet(str(tmp_path / "d/metadata")).count() == 8
    m.unpersist()
