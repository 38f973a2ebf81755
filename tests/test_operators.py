"""Operators on small tables, with the cases that break naive versions."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from chirplake.config import DatasetConfig
from chirplake.functions import scalars as S
from chirplake.operators import arrays as A
from chirplake.operators import audits, groups, pairs
from chirplake.operators.ranks import dense_number, hash_rank, quota_sizes
from chirplake.operators.scratch import saved, scratch_root
from chirplake.sources import catalog, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_source_group(spark):
    assert one(spark, S.source_group(F.lit("H1"), F.lit(1126259462.0))) == "H1:274965"


@pytest.mark.parametrize(("text", "value"), [("12", 12.0), ("12d", None), ("1_000", 1000.0), ("", None), (" 3.5 ", 3.5), ("1e3", 1000.0), ("abc", None), (None, None), ("-.5", -0.5)])
def test_strict_double(spark, text, value):
    assert one(spark, S.strict_double(F.lit(text).cast("string"))) == value


def test_nan_parses(spark):
    assert math.isnan(one(spark, S.strict_double(F.lit("nan"))))


def test_segment_keys_round_as_sql(spark):
    """Times of whole microseconds are halves of four places once in a hundred."""
    micros = [1704067211172450, 1704067211172350, 1704067211172449, 1704067211172451, 1126259462000050, 1126259462000150] + [1704067211000050 + k * 100 for k in range(2000)]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(x / 1e6::DOUBLE, 4) FROM (SELECT unnest(?) AS x)", [micros]).fetchall()]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(micros)], "k int, m bigint")
    got = rows.select("k", S.gps_key(F.lit("H1"), F.col("m") / F.lit(1e6)).alias("key")).orderBy("k").collect()
    assert [r["key"] for r in got] == [f"H1:{x:.4f}" for x in want]


def test_axis_and_area(spark):
    box = S.glitch_box(F.lit(1.0), F.lit(1.4), F.lit(100.0), F.lit(200.0))
    assert one(spark, S.box_area(box)) == pytest.approx(0.1 * math.log(2) / math.log(50))
    y = one(spark, S.yolo(S.clipped_box(F.lit(0.0), F.lit(4.0), F.lit(20.0), F.lit(500.0), 0, "x"), low=0.0, high=1000.0, scale="linear"))
    assert y["h"] == pytest.approx(0.48)
    assert one(spark, S.freq_to_unit(F.lit(5.0))) == 0
    assert one(spark, S.glitch_box(F.lit(5.0), F.lit(6.0), F.lit(100.0), F.lit(200.0))) is None


def test_row_frequencies_and_edges(spark):
    f = one(spark, S.row_frequencies(3))
    assert f[0] == pytest.approx(1000) and f[2] == pytest.approx(20)
    assert one(spark, S.edges(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)))) == [0.5, 1.5, 3.0, 5.0]
    assert one(spark, S.edges(F.array(F.lit(1.0)))) == [0.5, 1.5]


def test_overlap_with_missing_bounds(spark):
    assert one(spark, S.freq_overlap(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(2.0))) == 0
    assert one(spark, S.freq_overlap(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0))) == pytest.approx(1 / 3)


@pytest.mark.parametrize(("line", "strict", "lenient"), [("0 .5 .5 .1 .1", True, True), ("0.0 .5 .5 .1 .1", False, True), ("0 .5 .5 .1", False, False), ("", False, False), ("x 1 1 1 1", False, False)])
def test_label_lines(spark, line, strict, lenient):
    assert (one(spark, S.parse_yolo(F.lit(line))) is not None) == strict
    assert (one(spark, S.parse_yolo(F.lit(line), lenient=True)) is not None) == lenient


def test_box_mismatch(spark):
    def box(d):
        return F.struct(F.lit(0).alias("class_id"), F.lit(0.5 + d).alias("cx"), F.lit(0.67).alias("cy"), F.lit(0.99).alias("w"), F.lit(0.65).alias("h"))

    none = F.filter(F.array(box(0.0)), lambda b: F.lit(False))
    assert not one(spark, A.box_mismatch(box(0.0), F.array(box(0.3), box(0.005))))
    assert one(spark, A.box_mismatch(box(0.0), F.array(box(0.02))))
    assert one(spark, A.box_mismatch(box(0.0), none))


def test_largest_remainder(spark):
    sizes = {r["name"]: r["size"] for r in one(spark, quota_sizes(F.lit(50), {"train": 0.7, "val": 0.15, "test": 0.15}))}
    assert sizes == {"train": 35, "val": 8, "test": 7}


def test_ranks_are_dense(spark):
    df = spark.range(5000)
    ranks = [r["rank"] for r in hash_rank(df, F.md5(F.col("id").cast("string")), F.col("id")).orderBy("rank").collect()]
    assert ranks == list(range(1, 5001))
    numbered = dense_number(df.withColumn("g", (F.col("id") % 2)), ["g"], F.floor(F.col("id") / 100), [F.col("id")], "k").orderBy("g", "id")
    assert [r["k"] for r in numbered.collect()] == list(range(1, 5001))


def pool(spark):
    rows = [(i + 10 * g + (1000 if ifo == "L1" else 0), ifo, (500000.0 + g) * 4096 + 10 + 300 * i, "Blip" if g else "Tomte") for ifo in ("H1", "L1") for g in range(10) for i in range(5)]
    df = spark.createDataFrame(rows, "ord bigint, ifo string, gps double, label string")
    return df.withColumn("grp", S.source_group(F.col("ifo"), F.col("gps"))).withColumn("fid", F.floor(F.col("gps") / 4096).cast("bigint"))


def test_allocation(spark):
    p = pool(spark)
    got = groups.assign_groups(groups.group_counts(p)).toPandas()
    assert len(got) == 20 and got["grp"].is_unique
    share = got.groupby("split")["n"].sum() / got["n"].sum()
    assert abs(share["train"] - 0.7) <= 0.1
    assert groups.uncovered(groups.coverage(p, groups.assign_groups(groups.group_counts(p)), ("train", "val", "test"), ("H1", "L1"))).count() == 0


def test_grid_and_range_anti(spark):
    p = pool(spark)
    grid = groups.offsource_grid(p.select("ifo", "grp", "fid").distinct())
    assert grid.groupBy("ifo", "grp").count().select("count").distinct().collect()[0][0] == 128
    fast = {tuple(r) for r in groups.outside(grid, p).collect()}
    g = grid.alias("g")
    slow = {tuple(r) for r in g.join(p.alias("p"), (F.col("g.ifo") == F.col("p.ifo")) & (F.abs(F.col("g.gps") - F.col("p.gps")) < 8.0), "left_anti").collect()}
    assert fast == slow and fast


def test_subset_tops_up_classes(spark):
    rows = [(k, "H1", 4096.0 * f + 1, label) for k, (f, label) in enumerate([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "c"), (3, "c"), (4, "b")])]
    p = spark.createDataFrame(rows, "ord bigint, ifo string, gps double, label string").withColumn("fid", F.floor(F.col("gps") / 4096).cast("bigint"))
    got = {r["fid"]: r["reason"] for r in groups.subset_files(p, 2).collect()}
    # b takes file 2 (first of equals); c is covered by it now and still adds the file with most of it.
    assert got == {1: "greedy", 2: "topup:b", 3: "topup:c"}


def test_first_accepted(spark):
    keys = spark.range(3).withColumnRenamed("id", "k")
    got = {r["k"]: r["attempt"] for r in groups.first_accepted(keys, 4, lambda df: df.withColumn("accepted", (F.col("attempt") >= F.col("k")) & (F.col("k") < 2))).collect()}
    assert got == {0: 0, 1: 1, 2: None}


SAMPLE = "ord bigint, sample_id string, event_id string, chirp_id string, detector string, split string, global_class string, has_chirp int, has_glitch int, snr_bin string, label_low double, label_high double, injection_time double"


def samples(spark, n=12):
    rows = []
    classes = ("bbh_clean", "bns_clean", "bbh_glitch", "pure_noise", "bns_glitch", "bbh_clean")
    for e in range(n):
        c = classes[e % 6]
        has = c != "pure_noise"
        for d, det in enumerate(("H1", "L1")):
            low = 20.0 + e
            rows.append((2 * e + d, f"s{e}{det}", f"e{e}", f"c{e}" if has else None, det, "train", c, int(has), int("glitch" in c), "low" if has else None, low if has else None, low + 50 if has else None, 1.0 + 0.001 * e if has else None))
    return spark.createDataFrame(rows, SAMPLE)


def test_negatives_obey_their_predicates(spark):
    s = samples(spark)
    for kind in (*pairs.HARD_TYPES, *pairs.EASY_TYPES):
        for r in pairs.one_per_anchor(s, kind).collect():
            if kind == "invalid_delay_same_chirp":
                assert r["same_chirp"] == 1 and r["valid_time_delay"] == 0 and r["time_delay_difference"] == pytest.approx(0.096)
            else:
                assert r["anchor_event_id"] != r["candidate_event_id"]
            if kind == "similar_frequency_different_chirp":
                assert r["frequency_overlap_score"] > 0.3
            if kind == "different_chirp_cross_detector":
                assert r["anchor_detector"] != r["candidate_detector"]
            if kind == "same_detector_different_event":
                assert r["anchor_detector"] == r["candidate_detector"]


def test_pair_tables(spark):
    s = samples(spark)
    positives, negatives = pairs.positive_pairs(s), pairs.negative_pairs(s)
    combined = pairs.combined_pairs(s, positives, negatives)
    ids = sorted(r["pair_id"] for r in combined.select("pair_id").collect())
    assert ids == list(range(1, len(ids) + 1))
    # No glitch-only rows and none with a glitch and no chirp: that type is off.
    assert negatives.where("negative_type = 'chirp_vs_glitch'").isEmpty()
    report = audits.rollup(s.withColumn("noise_type", F.lit("x")).withColumn("background_source", F.lit(None).cast("string")).withColumn("background_source_group", F.lit(None).cast("string")).withColumn("glitch_id", F.lit(None).cast("string")).withColumn("glitch_source_group", F.lit(None).cast("string")).withColumn("glitch_gps", F.lit(None).cast("double")), positives, negatives, combined)
    audits.require(report)


def test_audit_finds_leaks(spark):
    rows = [("s1", "e1", "c1", "train", "H1"), ("s2", "e1", "c1", "val", "L1"), ("s3", "", None, "train", "H1"), ("s4", "", "", "val", "H1")]
    m = spark.createDataFrame(rows, "sample_id string, event_id string, chirp_id string, split string, detector string")
    assert [r["key"] for r in audits.event_leaks(m).collect()] == ["e1"]
    assert audits.chirp_leaks(m).first()["splits"] == "train,val"
    assert "1 offenders" in audits.offenders(audits.event_leaks(m))


def test_missing_sample_fails_the_split_check(spark):
    p = spark.createDataFrame([(1, "a", "zz", "train")], "pair_id bigint, anchor_sample_id string, candidate_sample_id string, split string")
    m = spark.createDataFrame([("a", "e", "c", "train")], "sample_id string, event_id string, chirp_id string, split string")
    assert audits.cross_split_pairs(p, m).count() == 1
    assert audits.cross_split_pairs(p, m, allow=True).count() == 0


def test_zero_counts_as_missing(spark):
    rows = spark.createDataFrame([(0.0, 80.0, 0.0, None, 10.0)], "peak_frequency double, central_freq double, duration double, snr double, bandwidth double")
    r = catalog.with_defaults(rows).first()
    assert (r["peak"], r["duration"], r["snr"], r["band_low"], r["band_high"]) == (80.0, 0.5, 0.0, 70.0, 90.0)


def test_catalog_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("IFO,ml_label,peak_time,peak_time_ns,ml_confidence\nH1,Blip,100,500000000,0.95\nH1,Blip,x,1,0.95\nL1,Blip,100,,0.5\nL1,Tomte,7,,oops\n")
    (tmp_path / "b.tsv").write_text("ifo\tml_label\tpeak_time\nL1\tBlip\t9\n")
    raw = catalog.as_pool(catalog.read_text_tables(spark, [str(tmp_path / "a.csv")]))
    kept = groups.confident(raw, F.col("confidence"), 0.9, ("H1", "L1")).collect()
    assert sorted((r["ifo"], r["gps"], r["label"]) for r in kept) == [("H1", 100.5, "Blip"), ("L1", 7.0, "Tomte")]
    with pytest.raises(catalog.CatalogError):
        catalog.as_pool(spark.createDataFrame([(1,)], "x int"))


def test_pool_file_is_checked(spark, tmp_path):
    path = tmp_path / "pool.csv"
    path.write_text("gps,ifo,label,snr,duration\n1126259462,H1,Blip,12,0.5\n1126259500,H1,Blip,12,0.5\n")
    with pytest.raises(catalog.CatalogError, match="L1"):
        catalog.read_pool(spark, str(path))
    assert catalog.read_pool(spark, str(path), ("H1",)).count() == 2


def test_fetch_outcomes(spark):
    wanted = spark.createDataFrame([("H1", 1.0), ("H1", 2.0), ("H1", 3.0), ("H1", 4.0), ("H1", 4.0)], "ifo string, gps double")
    cache = spark.createDataFrame([("H1", 1.0)], "ifo string, gps double")
    listed = spark.createDataFrame([("H1:2.0000",)], "key string")

    def fetch(ifo, gps, rate, halfwin):
        if gps == 3.0:
            raise RuntimeError("404 not found")
        return [1.0] * int(2 * halfwin * rate)

    got = {r["gps"]: r["outcome"] for r in catalog.fetch_segments(wanted, cache, listed, fetch, rate=4, halfwin=1.0).collect()}
    assert got == {3.0: "unavailable", 4.0: "fetched"}


def test_blacklist_file(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(["H1:1.0000"]))
    (tmp_path / "broken.json").write_text("{")
    assert catalog.read_blacklist(spark, str(tmp_path / "b.json")).count() == 1
    assert catalog.read_blacklist(spark, str(tmp_path / "broken.json")).count() == 0
    assert catalog.read_blacklist(spark, str(tmp_path / "none.json")).count() == 0


def test_csv_text(spark):
    df = spark.createDataFrame([(1.0 / 3, None, ["a", "b"], float("nan"))], "x double, y string, z array<string>, w double")
    assert tuple(sinks.as_csv(df, ["x", "y", "z", "w", "absent"]).first()) == ("0.333333", "", "a;b", "", "")


@pytest.mark.parametrize("wrong", [{"num_events": 0}, {"ratios": {"train": 0.5, "val": 0.1, "test": 0.1}}, {"sample_rate": 1000}, {"noise_source": "gwosc"}, {"noise_source": "gwosc", "glitch_source": "gwosc", "synthetic_fallback": True}, {"detectors": ("V1",)}, {"detectors": ("H1", "H1")}, {"vmin": 30.0}, {"norm_method": "x"}, {"hard_fraction": 2.0}, {"injection_min": 3.5}, {"bin_weights": {"low": 1.0}}])
def test_config_errors(wrong):
    with pytest.raises(ValueError):
        DatasetConfig(**wrong)


def test_empty_tables(spark):
    p = pool(spark).limit(0)
    assert groups.assign_groups(groups.group_counts(p)).count() == 0
    assert groups.outside(p, p).count() == 0
    s = samples(spark).limit(0)
    assert pairs.positive_pairs(s).count() == 0
    assert pairs.negative_pairs(s).count() == 0


def test_overlapping_ranges_lose_none(spark):
    """The keyed join against all pairs, over ranges of all widths, some empty."""
    import numpy as np

    rng = np.random.default_rng(4)
    low = 10 ** rng.uniform(1.3, 3, 400)
    high = low + np.where(rng.random(400) < 0.1, 0, 10 ** rng.uniform(-2, 3, 400))
    rows = [("train", k, float(a), float(b), f"c{k}") for k, (a, b) in enumerate(zip(low, high, strict=True))]
    left = spark.createDataFrame(rows, "split string, k int, label_low double, label_high double, chirp_id string")
    right = spark.createDataFrame(rows, "split string, c_k int, c_label_low double, c_label_high double, c_chirp_id string")
    got = {(r["k"], r["c_k"]) for r in pairs._overlapping(left, right, ("split",)).select("k", "c_k").collect()}
    want = set()
    for _, i, a, b, _ in rows:
        for _, j, c, d, _ in rows:
            union = max(b, d) - min(a, c)
            if i != j and union > 0 and max(0.0, min(b, d) - max(a, c)) / union > pairs.MIN_OVERLAP:
                want.add((i, j))
    assert got == want and len(want) > 1000


def test_numbers_over_super_blocks(spark, monkeypatch):
    from chirplake.operators import ranks

    monkeypatch.setattr(ranks, "SUPER_BLOCK", 3)
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), (F.col("id") % 2).alias("lead"))
    got = ranks.dense_number(rows, ["lead"], F.floor(F.col("k") / 10), [F.col("k")], "n").orderBy("lead", "k").collect()
    assert [r["n"] for r in got] == list(range(1, 501))


@pytest.mark.parametrize(("first", "cell"), [(4, 24), (1, 2)])
def test_range_draw_is_even_over_all_matches(spark, monkeypatch, first, cell):
    """Rare matches, a crowd just beyond the limit, and more slots than any draw could fill by luck: each match is as likely, and none is missed."""
    monkeypatch.setattr(pairs, "FIRST_ATTEMPTS", first)
    monkeypatch.setattr(pairs, "CELL_ATTEMPTS", cell)
    ranges = [(100.0, 110.0)] * 2 + [(101.0, 112.0), (97.0, 107.0), (104.0, 111.0), (100.5, 109.0), (99.0, 120.0)] + [(108.0, 118.0)] * 300 + [(400.0 + k, 700.0 + k) for k in range(200)]
    rows = [(2 * k, f"s{k}", f"e{k}", f"c{k}", "H1", "train", "bbh_clean", 1, 0, "low", lo, hi, 1.0) for k, (lo, hi) in enumerate(ranges)]
    rows.append((9999, "alone", "e9999", "c9999", "H1", "train", "bbh_clean", 1, 0, "low", 5000.0, 5000.5, 1.0))
    s = spark.createDataFrame(rows, SAMPLE)
    anchors = s.where("sample_id in ('s0', 'alone')").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(1200))))
    got = pairs.pick(anchors, s, "similar_frequency_different_chirp").groupBy("sample_id", "c_sample_id").count().collect()
    assert {r["sample_id"] for r in got} == {"s0"}
    counts = {r["c_sample_id"]: r["count"] for r in got}
    assert set(counts) == {f"s{k}" for k in range(1, 7)} and sum(counts.values()) == 1200
    assert all(abs(n - 200) < 5 * 200**0.5 for n in counts.values())


def test_numbers_within_keys(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SUPER_BLOCK", 2)
    monkeypatch.setattr(pairs, "BLOCK", 5)
    rows = spark.range(300).select((F.col("id") * 3).alias("ord"), (F.col("id") % 3).alias("key"))
    got = pairs._numbered(rows, ("key",)).collect()
    assert all(r["idx"] == r["ord"] // 9 for r in got)


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_scratch_tables_leave_no_shuffles(spark):
    before = _shuffle_files(spark)
    got = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert got.count() == 7
    made = _shuffle_files(spark)
    saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert _shuffle_files(spark) == made and made - before <= 8  # those of the count itself


def test_draws_keep_three_numbers_and_no_tables(spark):
    """What a draw needs on the way is deleted, and what it leaves is narrow."""
    s = samples(spark)
    anchors = s.where("has_chirp = 1").withColumn("slot", F.lit(0))
    for kind in (*pairs.HARD_TYPES, *pairs.EASY_TYPES):
        got = pairs.chosen(anchors, s, kind)
        assert got.columns == ["ord", "slot", "c_ord"]
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
        left = {f.getPath().getName().split("-")[0] for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)}
        assert not left & {"pool", "first", "again", "rest", "near", "last"}
