"""The remote source, table functions, pictures and the command line."""

import sys

import pytest
from pyspark.sql import functions as F

from chirplake import __main__ as cli
from chirplake.config import DatasetConfig
from chirplake.functions import table_functions
from chirplake.operators import synthesis
from chirplake.sources import catalog, remote, sinks


def test_remote_catalog(spark, tmp_path):
    (tmp_path / "some_archive.py").write_text("def fetch(selection):\n    assert isinstance(selection, dict)\n    for k in range(10):\n        yield {'gps': float(k), 'ifo': 'H1' if k % 2 else 'L1', 'label': 'Blip', 'confidence': k / 10}\n\ndef plain():\n    return [{'gps': 1.0, 'ifo': 'H1', 'label': 'Blip'}]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "some_archive.py"))
    remote.register(spark)
    read = lambda f: spark.read.format("remote_catalog").option("fetcher", f"some_archive:{f}").option("ifos", "H1,L1").load()
    assert sorted(r["gps"] for r in read("fetch").where("confidence > 0.55 and ifo = 'H1'").collect()) == [7.0, 9.0]
    assert read("plain").count() == 1
    with pytest.raises(Exception, match="fetcher"):
        spark.read.format("remote_catalog").load().count()


def test_functions_in_sql(spark):
    table_functions.register(spark)
    assert spark.sql("SELECT count(*) FROM offsource_points(10, 4.0D, 32.0D)").first()[0] == 128
    r = spark.sql("SELECT * FROM box_corners('0 0.5 0.5 0.2 0.4\nbad line', 100, 50)").collect()
    assert len(r) == 1 and r[0]["left"] == pytest.approx(40) and r[0]["bottom"] == pytest.approx(35)
    assert spark.sql("SELECT robust_sigma(x) FROM VALUES (1.0D), (2.0D), (4.0D), (100.0D) t(x)").first()[0] == pytest.approx(1.4826 * 1.5)


def test_boxed_pictures_and_sheets(spark):
    config = DatasetConfig(duration=1.0, injection_min=0.3, injection_max=0.9, sample_rate=2048, image_width=24, image_height=24)
    made = synthesis.synthesized(synthesis.detector_draws(synthesis.event_draws(spark.range(3).withColumnRenamed("id", "num"), config), config), config, arrays=True)
    got = made.select(sinks.boxed_picture(F.col("energy"), F.col("boxes"), 1.0).alias("png"), sinks.strain_file(F.col("strain")).alias("npy")).collect()
    assert len(got) == 6 and all(bytes(r["png"])[:4] == b"\x89PNG" and bytes(r["npy"])[:6] == b"\x93NUMPY" for r in got)
    assert all(bytes(r["sheet"])[:4] == b"\x89PNG" for r in sinks.contact_sheets(made, "global_class").collect())


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sys, "argv", ["chirplake"])
    source = tmp_path / "catalog.csv"
    rows = [f"{1e9 + 4096 * (k % 5) + k},{'H1' if k % 2 else 'L1'},{'Blip' if k % 3 else 'Tomte'},{0.95 if k % 4 else 0.1}" for k in range(60)]
    source.write_text("\n".join(["gps,ifo,label,ml_confidence", *rows]) + "\n")
    assert cli.main(["pool", "--from-file", str(source), "--out", str(tmp_path / "pool")]) == 0
    assert cli.main(["subset", "--pool", str(tmp_path / "pool"), "--out", str(tmp_path / "subset"), "--per-detector", "5"]) == 0
    assert cli.main(["build", "--out", str(tmp_path / "data"), "--num-events", "12", "--sample-rate", "2048", "--image-size", "24"]) == 0
    assert (tmp_path / "data/_COMPLETE").exists()
    assert cli.main(["audit", "--metadata", str(tmp_path / "data/metadata_csv")]) == 0


def test_resumable_loop_appends_nothing_twice(spark, tmp_path):
    from chirplake.streaming import groups as stream

    spark.range(6).withColumnRenamed("id", "k").repartition(3).write.parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")

    def done(session):
        try:
            return session.read.parquet(sink).select("k")
        except Exception:
            return session.createDataFrame([(2,)], "k bigint")  # 2 is on the blacklist

    for n in range(2):  # the second time without the memory of the first
        source = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.resumable(source, str(tmp_path / f"check{n}"), done, ["k"], lambda rows: rows.withColumn("made", F.col("k") * 2), sink)
    got = sorted(r["k"] for r in spark.read.parquet(sink).collect())
    assert len(got) == len(set(got)) and set(got) >= {0, 1, 3, 4, 5}


def test_pictures_join_their_labels(spark, tmp_path):
    from chirplake.sources import catalog

    for name in ("a", "b"):
        (tmp_path / "pic/train/H1").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"pic/train/H1/{name}.png").write_bytes(b"png")
    (tmp_path / "lab/train/H1").mkdir(parents=True)
    (tmp_path / "lab/train/H1/a.txt").write_text("0 0.5 0.5 0.1 0.1\n1.0 0.5 0.5 0.1 0.1\nbroken\n")
    got = lambda lenient: {r["sample_id"]: len(r["boxes"]) for r in catalog.labelled(catalog.read_pictures(spark, str(tmp_path / "pic")), catalog.read_labels(spark, str(tmp_path / "lab"), lenient)).collect()}
    assert got(False) == {"a": 1, "b": 0} and got(True) == {"a": 2, "b": 0}


def test_caps_follow_the_order_of_arrival(spark, tmp_path):
    """Files of very different sizes, given in no order, cut into many blocks: the cap is that of a plain loop over them."""
    from chirplake.operators import groups

    sizes = {"z.csv": 900, "a.csv": 3, "m b.csv": 400, "k.tsv": 250}
    plain, taken = [], {}
    for name, n in sizes.items():
        sep = "\t" if name.endswith("tsv") else ","
        head = ("gps", "ifo", "label", "snr") if name != "a.csv" else ("label", "gps", "ifo", "snr")
        rows = []
        for k in range(n):
            row = {"gps": f"{len(plain)}.0", "ifo": "H1" if k % 3 else "L1", "label": f"c{k * 7919 % 5}", "snr": str(k)}
            plain.append((float(row["gps"]), row["ifo"], row["label"]))
            rows.append(sep.join(row[c] for c in head))
        (tmp_path / name).write_text("\n".join([sep.join(head), *rows]) + "\n")
    want = []
    for gps, ifo, label in plain:
        taken[ifo, label] = taken.get((ifo, label), 0) + 1
        if taken[ifo, label] <= 60:
            want.append((gps, ifo, label))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        pool = catalog.as_pool(catalog.read_text_tables(spark, [str(tmp_path / name) for name in sizes]))
        assert pool.rdd.getNumPartitions() > 8
        got = groups.capped(pool, ["ifo", "label"], [F.col("arrival")], 60).orderBy("arrival").select("gps", "ifo", "label").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == want


def test_the_last_of_repeated_samples_counts(spark, tmp_path):
    from chirplake.operators import audits

    lines = ["sample_id,event_id,chirp_id,split,detector", *[f"s{k % 40},e,c{k},train,H1" for k in range(400)]]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    pairs = spark.createDataFrame([("s3", "s3", "train")], "anchor_sample_id string, positive_sample_id string, split string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = audits._both_sides(pairs, catalog.read_metadata(spark, str(tmp_path / "m.csv"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["a_chirp_id"] == "c363"


def test_cache_reads_what_is_asked_for(spark, tmp_path):
    from chirplake.config import DatasetConfig
    from chirplake.operators import segments

    config, path = DatasetConfig(sample_rate=2048, halfwin=0.01), str(tmp_path / "cache")
    schema = catalog.CACHE_SCHEMA
    rows = [(ifo, 4096.0 * f + k, 2048, 0.01, [float(f)] * 41, "fetched") for ifo in ("H1", "L1") for f in range(6) for k in (10.0, 20.0)]
    got = spark.createDataFrame([*rows, rows[0], ("H1", 99.0, 2048, 0.01, None, "unavailable")], schema)
    catalog.store_segments(got, path)
    catalog.store_segments(got, path)  # a second time stores nothing
    cache = catalog.read_cache(spark, path, 2048, 0.01)
    assert cache.count() == len(rows) == cache.select("key").distinct().count()
    assert catalog.read_cache(spark, path, 4096, 0.01).count() == 0
    asked = spark.createDataFrame([(1, "H1", 10.0), (2, "H1", 4096.0 * 3 + 20), (3, "H1", 10.0), (4, "L1", 5.0)], "sample int, ifo string, gps double")
    found = segments.with_data(asked, segments.Segments(None, path, str(tmp_path / "listed")), config)
    assert sorted((r["sample"], r["data"][0]) for r in found.collect()) == [(1, 0.0), (2, 3.0), (3, 0.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    scan = found.select("data").inputFiles()
    assert len(scan) > 0
    pruned = catalog.read_cache(spark, path, 2048, 0.01, asked.select("ifo", catalog.file_number(F.col("gps")).alias("fid")))
    read = {r["f"] for r in pruned.select(F.input_file_name().alias("f")).distinct().collect()}
    assert all(("ifo=H1/fid=0/" in f) or ("ifo=H1/fid=3/" in f) or ("ifo=L1/fid=0/" in f) for f in read)
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().executedPlan().toString()
