"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.config import DEFAULT, DETECTORS, SPLITS
from chirplake.functions import draws, qscan
from chirplake.functions import scalars as S
from chirplake.operators import arrays as A
from chirplake.operators import audits, groups, pairs, synthesis
from chirplake.operators.ranks import quota_sizes
from chirplake.operators.scratch import saved, scratch_root
from chirplake.plans import sql_pairs as Q
from chirplake.plans.sql_views import CELLS, EVENTS, POOL, SAMPLES, SERIES, SIZES, digest_key, u
from chirplake.sources import views as V
from chirplake.streaming import groups as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def samples_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The samples, or these columns of them, as a table in the scratch folder, for queries that read them many times."""
    return saved(V.samples(spark, sf_dir).select(*(columns or "*")), "samples")


#: What pairs are drawn and told from.
_FOR_PAIRS = ("split", "ord", "global_class", "has_chirp", "has_glitch", "sample_id", "event_id", "chirp_id", "detector", "snr_bin", "label_low", "label_high", "injection_time")


def n_of(df: DataFrame, *names: str) -> DataFrame:
    """Counts as bigint."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


# ----------------------------------------------------------------- pools
@query("""SELECT event_id AS ord, CASE WHEN user_id % 2 = 0 THEN 'H1' ELSE 'L1' END AS ifo, event_type AS label, value AS snr
  FROM events WHERE event_type IN ('view', 'click', 'error') AND coalesce(TRY_CAST(props->>'$.k' AS DOUBLE) >= 30, true)""")
def pool_scan_filter(spark, sf_dir):
    p = V.pool(spark, sf_dir, F.get_json_object("props", "$.k").alias("conf"))
    kept = groups.confident(p, S.strict_double(F.col("conf")), 30.0, DETECTORS, ("view", "click", "error"))
    return kept.select("ord", "ifo", "label", "snr")


@query(f"""WITH {POOL} SELECT ord, ifo, label, snr FROM pool QUALIFY row_number() OVER (PARTITION BY ifo, label ORDER BY ord) <= 300""")
def pool_alias_cap(spark, sf_dir):
    return groups.capped(V.pool(spark, sf_dir), ["ifo", "label"], [F.col("ord")], 300).select("ord", "ifo", "label", "snr")


_FILES = f"""WITH {POOL}, files AS (SELECT ifo, fid, count(*) AS n, min(ord) AS first_ord FROM gpool GROUP BY ifo, fid),
  run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ifo ORDER BY n DESC, first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files)"""


@query(f"{_FILES} SELECT ifo, fid, n, before::BIGINT AS before FROM run WHERE before < 2000")
def pool_subset_greedy(spark, sf_dir):
    return n_of(groups.greedy_files(V.pool(spark, sf_dir), 2000).where("taken").select("ifo", "fid", "n", "before"), "n", "before")


@query(f"""WITH RECURSIVE {POOL}, fine AS (SELECT ifo, fid, ord, label || (ord % 12)::VARCHAR AS label FROM gpool),
  files AS (SELECT ifo, fid, count(*) AS n, min(ord) AS first_ord FROM fine GROUP BY ifo, fid),
  run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ifo ORDER BY n DESC, first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40 AS taken FROM files),
  missing AS (SELECT ifo, label, row_number() OVER (PARTITION BY ifo ORDER BY label) AS k FROM (
    SELECT DISTINCT ifo, label FROM fine EXCEPT SELECT f.ifo, f.label FROM fine f JOIN run r ON r.ifo = f.ifo AND r.fid = f.fid WHERE taken)),
  held AS (SELECT ifo, label, fid, count(*) AS n FROM fine GROUP BY ALL),
  ranked AS (SELECT m.ifo, m.k, list(r.fid ORDER BY coalesce(h.n, 0) DESC, r.first_ord) AS best FROM missing m JOIN run r ON r.ifo = m.ifo
    LEFT JOIN held h ON h.ifo = m.ifo AND h.label = m.label AND h.fid = r.fid WHERE NOT taken GROUP BY m.ifo, m.k),
  fold AS (SELECT ifo, 0::BIGINT AS k, []::BIGINT[] AS picked FROM (SELECT DISTINCT ifo FROM files)
    UNION ALL SELECT f.ifo, r.k, list_append(f.picked, list_filter(r.best, lambda x: NOT list_contains(f.picked, x))[1]) FROM fold f JOIN ranked r ON r.ifo = f.ifo AND r.k = f.k + 1)
  SELECT ifo, fid, 'greedy' AS reason FROM run WHERE taken
  UNION ALL SELECT f.ifo, f.picked[f.k], 'topup:' || m.label FROM fold f JOIN missing m ON m.ifo = f.ifo AND m.k = f.k WHERE f.k > 0""")
def pool_subset_topup(spark, sf_dir):
    fine = V.pool(spark, sf_dir).withColumn("label", F.concat("label", (F.col("ord") % 12).cast("string")))
    return groups.subset_files(fine, 40)


@query(f"WITH {POOL} SELECT ifo, grp, count(*) AS n FROM gpool GROUP BY ifo, grp")
def source_group_counts(spark, sf_dir):
    return groups.group_counts(V.pool(spark, sf_dir))


_ASSIGN = f"""WITH RECURSIVE {POOL}, counts AS (SELECT ifo, grp, count(*) AS n FROM gpool GROUP BY ifo, grp),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ifo ORDER BY n DESC, md5({digest_key('group', 'grp')}), grp) AS k, sum(n) OVER (PARTITION BY ifo) AS total FROM counts),
  fold AS (
    SELECT ifo, 0::BIGINT AS k, total * 0.70::DOUBLE AS a, total * 0.15::DOUBLE AS b, total * 0.15::DOUBLE AS c, NULL::VARCHAR AS grp, 0::BIGINT AS n, NULL::VARCHAR AS split
    FROM (SELECT DISTINCT ifo, total FROM ranked)
    UNION ALL
    SELECT f.ifo, r.k, CASE WHEN s = 'train' THEN a - r.n ELSE a END, CASE WHEN s = 'val' THEN b - r.n ELSE b END, CASE WHEN s = 'test' THEN c - r.n ELSE c END, r.grp, r.n, s
    FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS s FROM fold) f JOIN ranked r ON r.ifo = f.ifo AND r.k = f.k + 1),
  assigned AS (SELECT ifo, grp, n, split FROM fold WHERE k > 0)"""


@query(f"{_ASSIGN} SELECT * FROM assigned")
def group_split_assign(spark, sf_dir):
    return groups.assign_groups(groups.group_counts(V.pool(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT name AS split, size::BIGINT AS size FROM sizes")
def split_largest_remainder(spark, sf_dir):
    total = V.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    return total.select(F.explode(quota_sizes(F.col("n"), DEFAULT.ratios)).alias("q")).select(F.col("q.name").alias("split"), F.col("q.size").alias("size"))


@query(f"""{_ASSIGN} SELECT s.split, d.ifo, coalesce(sum(n), 0)::BIGINT AS rows, count(n) AS files
  FROM (SELECT unnest(['train', 'val', 'test']) AS split) s CROSS JOIN (SELECT unnest(['H1', 'L1']) AS ifo) d
  LEFT JOIN assigned a ON a.split = s.split AND a.ifo = d.ifo GROUP BY ALL""")
def split_coverage(spark, sf_dir):
    pool = V.pool(spark, sf_dir)
    return groups.coverage(pool, groups.assign_groups(groups.group_counts(pool)), SPLITS, DETECTORS)


_GRID = f"WITH {POOL}, grid AS (SELECT ifo, grp, fid * 4096 + 4 + k * 32.0::DOUBLE AS gps FROM (SELECT DISTINCT ifo, grp, fid FROM gpool), range(128) t(k))"


@query(f"{_GRID} SELECT ifo, grp, gps FROM grid")
def offsource_grid(spark, sf_dir):
    return groups.offsource_grid(V.pool(spark, sf_dir).select("ifo", "grp", "fid").distinct())


_OFF = f"{_GRID}, off AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM gpool p WHERE p.ifo = g.ifo AND p.fid BETWEEN floor(g.gps / 4096) - 1 AND floor(g.gps / 4096) + 1 AND abs(p.gps - g.gps) < 8))"


def _offsource(spark, sf_dir):
    pool = V.pool(spark, sf_dir)
    return groups.outside(groups.offsource_grid(pool.select("ifo", "grp", "fid").distinct()), pool)


@query(f"{_OFF} SELECT ifo, grp, gps FROM off")
def offsource_range_anti(spark, sf_dir):
    return _offsource(spark, sf_dir)


_CACHED = f"{u('cached', 'o.ifo', 'o.gps::BIGINT')} < 0.02"


@query(f"""{_ASSIGN}, grid AS (SELECT ifo, grp, fid * 4096 + 4 + k * 32.0::DOUBLE AS gps FROM (SELECT DISTINCT ifo, grp, fid FROM gpool), range(128) t(k)),
  off AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM gpool p WHERE p.ifo = g.ifo AND p.fid BETWEEN floor(g.gps / 4096) - 1 AND floor(g.gps / 4096) + 1 AND abs(p.gps - g.gps) < 8)),
  c AS (SELECT o.*, split, split <> 'val' AND {_CACHED} AS cached FROM off o JOIN assigned a ON a.grp = o.grp)
  SELECT split, ifo, grp, gps, cached FROM c QUALIFY cached = max(cached) OVER (PARTITION BY split, ifo)""")
def offsource_cached_first(spark, sf_dir):
    """Per split and detector the cached candidates, where there are any (none are in val)."""
    pool = V.pool(spark, sf_dir)
    c = _offsource(spark, sf_dir).join(groups.assign_groups(groups.group_counts(pool)).select("grp", "split"), "grp")
    c = c.withColumn("cached", (F.col("split") != "val") & (draws.u("cached", F.col("ifo"), F.col("gps").cast("bigint")) < 0.02))
    return groups.cached_first(c, ["split", "ifo"]).select("split", "ifo", "grp", "gps", "cached")


@query(f"WITH {POOL} SELECT ord, ifo, label, snr FROM pool p WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.label = 'error' AND b.ifo = p.ifo AND floor(b.gps / 64) = floor(p.gps / 64))")
def blacklist_anti(spark, sf_dir):
    pool = V.pool(spark, sf_dir).withColumn("slot", F.floor(F.col("gps") / 64))
    return groups.not_listed(pool, pool.where("label = 'error'"), ["ifo", "slot"]).select("ord", "ifo", "label", "snr")


_KEYED = f"WITH {POOL}, keyed AS (SELECT ord, ifo, label, round(gps, 4) AS key FROM pool)"


@query(f"""{_KEYED}, wanted AS (SELECT DISTINCT ifo, key FROM keyed),
  bad AS (SELECT DISTINCT ifo, key FROM keyed WHERE label = 'error'), hit AS (SELECT DISTINCT ifo, key FROM keyed WHERE label IN ('view', 'click'))
  SELECT ifo, CASE WHEN b THEN 'unavailable' WHEN h THEN 'cached' ELSE 'to_fetch' END AS outcome, count(*) AS n
  FROM (SELECT w.ifo, EXISTS (SELECT 1 FROM bad x WHERE x.ifo = w.ifo AND x.key = w.key) AS b, EXISTS (SELECT 1 FROM hit x WHERE x.ifo = w.ifo AND x.key = w.key) AS h FROM wanted w) GROUP BY ALL""")
def prefetch_outcomes(spark, sf_dir):
    pool = V.pool(spark, sf_dir).withColumn("key", S.gps_key(F.col("ifo"), F.col("gps")))
    return groups.prefetch_outcomes(pool, pool.where("label in ('view', 'click')"), pool.where("label = 'error'"))


@query(f"{_ASSIGN} SELECT p.ord, p.ifo, p.grp, a.split FROM gpool p JOIN assigned a ON p.grp = a.grp WHERE NOT EXISTS (SELECT 1 FROM gpool b WHERE b.label = 'error' AND b.ifo = p.ifo AND round(b.gps, 4) = round(p.gps, 4))")
def pool_rows_by_split(spark, sf_dir):
    pool = V.pool(spark, sf_dir)
    listed = pool.where("label = 'error'").select(S.gps_key(F.col("ifo"), F.col("gps")).alias("key"))
    return groups.pool_rows(pool, groups.assign_groups(groups.group_counts(pool)), listed).select("ord", "ifo", "grp", "split")


@query(f"""{_ASSIGN}, grid AS (SELECT ifo, grp, fid * 4096 + 4 + k * 32.0::DOUBLE AS gps FROM (SELECT DISTINCT ifo, grp, fid FROM gpool), range(128) t(k)),
  off AS (SELECT g.*, a.split FROM grid g JOIN assigned a ON a.grp = g.grp WHERE NOT EXISTS (SELECT 1 FROM gpool p WHERE p.ifo = g.ifo AND p.fid BETWEEN floor(g.gps / 4096) - 1 AND floor(g.gps / 4096) + 1 AND abs(p.gps - g.gps) < 8)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY split, ifo ORDER BY grp, gps) - 1 AS i, count(*) OVER (PARTITION BY split, ifo) AS n FROM off), {SAMPLES},
  asked AS (SELECT s.sample_id, s.split, s.detector, floor({u('offsource', 's.sample_id')} * z.n)::BIGINT AS i FROM sample s JOIN (SELECT DISTINCT split, ifo, n FROM numbered) z ON z.split = s.split AND z.ifo = s.detector WHERE realnoise)
  SELECT q.sample_id, c.grp AS background_source_group, c.gps AS background_gps FROM asked q JOIN numbered c ON c.split = q.split AND c.ifo = q.detector AND c.i = q.i""")
def background_pick(spark, sf_dir):
    pool = V.pool(spark, sf_dir)
    candidates = _offsource(spark, sf_dir).join(groups.assign_groups(groups.group_counts(pool)).select("grp", "split"), "grp")
    wanted = V.samples(spark, sf_dir).where("noise_type = 'real_gwosc_offsource'").select("sample_id", "split", F.col("detector").alias("ifo"))
    got = groups.picked(wanted, candidates, ["split", "ifo"], ["grp", "gps"], draws.u("offsource", F.col("sample_id")))
    return got.select("sample_id", F.col("grp").alias("background_source_group"), F.col("gps").alias("background_gps"))


# ----------------------------------------------------------------- pairs
@query(f"WITH {Q.BASE}, {Q.POSITIVE} SELECT * FROM positives")
def positive_pairs(spark, sf_dir):
    return pairs.positive_pairs(V.samples(spark, sf_dir))


def _one(kind: str) -> Query:
    def run(spark, sf_dir):
        if kind == "same_detector_different_event":  # its samples are described once, so that events, a narrower table, are what is kept
            return pairs.one_per_anchor(V.detected(saved(V.astro_events(spark, sf_dir).drop("signal_type", "target_snr"), "events")).select(*_FOR_PAIRS), kind)
        return pairs.one_per_anchor(saved(pairs.involved(V.samples(spark, sf_dir), kind).select(*_FOR_PAIRS), "samples"), kind)

    return run


for _name, _kind in (
    ("neg_diff_chirp_xdet", "different_chirp_cross_detector"), ("neg_same_det_diff_event", "same_detector_different_event"), ("neg_chirp_glitch", "chirp_vs_glitch"),
    ("neg_chirp_noise", "chirp_vs_noise"), ("neg_similar_snr", "similar_snr_different_chirp"), ("neg_similar_freq", "similar_frequency_different_chirp"),
    ("neg_invalid_delay", "invalid_delay_same_chirp"),
):
    query(Q.one_per_anchor(_kind), _name)(_one(_kind))


@query(f"WITH {Q.BASE}, {Q.SLOTS} SELECT sample_id, split, slot::BIGINT AS slot, negative_type FROM slots")
def neg_slots(spark, sf_dir):
    return n_of(pairs.slots(V.samples(spark, sf_dir)).select("sample_id", "split", "slot", "negative_type"), "slot")


_SPLIT_TYPES = f"""WITH {Q.BASE}, {Q.NEGATIVES} SELECT split, negative_type, count(*) AS n, count(DISTINCT anchor_sample_id) AS anchors FROM negatives GROUP BY ALL"""


@query(_SPLIT_TYPES)
def neg_coverage_topup(spark, sf_dir):
    return pairs.coverage(pairs.drawn_negatives(V.samples(spark, sf_dir)))


@query(f"WITH {Q.BASE}, {Q.POSITIVE}, {Q.NEGATIVES} SELECT * FROM negatives")
def negative_pairs(spark, sf_dir):
    return pairs.negative_pairs(V.samples(spark, sf_dir))


@query(f"WITH {Q.BASE}, {Q.POSITIVE}, {Q.NEGATIVES}, {Q.COMBINED} SELECT * FROM combined")
def pairs_combined(spark, sf_dir):
    s = samples_once(spark, sf_dir, *_FOR_PAIRS)
    return pairs.combined_of(s, pairs.combined_numbers(pairs.drawn_positives(s), pairs.drawn_negatives(s)))


# ----------------------------------------------------------------- audits
_GROUP = "coalesce(nullif(glitch_source_group, ''), CASE WHEN glitch_gps IS NOT NULL THEN coalesce(detector, '') || ':' || floor(glitch_gps / 4096)::BIGINT::VARCHAR END)"


def _leaks(key: str, source: str = "sample", where: str = "true") -> str:
    return f"""SELECT key, count(*) AS n_splits, string_agg(split, ',' ORDER BY split) AS splits, sum(n)::BIGINT AS rows
  FROM (SELECT {key} AS key, split, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL) WHERE key <> '' GROUP BY key HAVING count(*) > 1"""


#: A table that leaks on purpose: each third event has its second detector in another split.
_LEAKY = f"""{SAMPLES}, leaky AS (SELECT * REPLACE (CASE WHEN num % 3 = 0 AND detector = 'L1' THEN 'test' ELSE split END AS split) FROM sample)"""


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(spark, sf_dir)
    return s.withColumn("split", F.when((F.col("num") % 3 == 0) & (F.col("detector") == "L1"), "test").otherwise(F.col("split")))


for _name, _check, _key, _where in (
    ("audit_event", audits.event_leaks, "event_id", "true"), ("audit_chirp", audits.chirp_leaks, "chirp_id", "true"),
    ("audit_glitch", audits.glitch_leaks, "glitch_id", "glitch_id <> ''"), ("audit_source_group", audits.source_group_leaks, _GROUP, "glitch_id <> ''"),
    ("audit_background_group", audits.background_group_leaks, "background_source_group", "true"),
):
    query(f"WITH {_LEAKY} {_leaks(_key, 'leaky', _where)}", _name)(lambda spark, sf_dir, check=_check: check(leaky(spark, sf_dir)))


_DOMAIN = "coalesce(nullif(background_source, ''), CASE noise_type WHEN 'real_gwosc' THEN 'gwosc' WHEN 'real_gwosc_offsource' THEN 'gwosc' WHEN 'gaussian_aligo_colored' THEN 'synthetic' ELSE nullif(noise_type, '') END)"
_DOMAINS = f"""domains AS (SELECT string_agg(DISTINCT d, ',' ORDER BY d) FILTER (WHERE g = 1) AS with_glitch, string_agg(DISTINCT d, ',' ORDER BY d) FILTER (WHERE g = 0) AS without_glitch
  FROM (SELECT {_DOMAIN} AS d, has_glitch AS g FROM sample) WHERE d IS NOT NULL)"""


@query(f"WITH {SAMPLES}, {_DOMAINS} SELECT coalesce(with_glitch, '') AS with_glitch, coalesce(without_glitch, '') AS without_glitch, coalesce(with_glitch <> without_glitch, false)::INT AS violations FROM domains")
def audit_background_domain(spark, sf_dir):
    return audits.background_domains(V.samples(spark, sf_dir))


_PAIR_BASE = f"WITH {Q.BASE}, {Q.POSITIVE}, {Q.NEGATIVES}, {Q.COMBINED}, leaky AS (SELECT * REPLACE (CASE WHEN num % 3 = 0 AND detector = 'L1' THEN 'test' ELSE split END AS split) FROM sample)"


@query(f"""{_PAIR_BASE} SELECT pair_id FROM combined p LEFT JOIN leaky a ON p.anchor_sample_id = a.sample_id LEFT JOIN leaky c ON p.candidate_sample_id = c.sample_id
  WHERE a.split IS DISTINCT FROM p.split OR c.split IS DISTINCT FROM p.split""")
def audit_pair_split(spark, sf_dir):
    s = samples_once(spark, sf_dir, *_FOR_PAIRS)
    combined = pairs.combined_numbers(pairs.drawn_positives(s), pairs.drawn_negatives(s))
    return audits.cross_split_pairs(combined, audits.known_by_number(s, leaky(spark, sf_dir), "split")).select("pair_id")


#: Metadata in which some chirps go by another name.
_RENAMED = "renamed AS (SELECT * REPLACE (CASE WHEN num % 7 = 0 AND detector = 'L1' THEN 'chirp_other' ELSE chirp_id END AS chirp_id) FROM sample)"


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.samples(spark, sf_dir).withColumn("chirp_id", F.when((F.col("num") % 7 == 0) & (F.col("detector") == "L1"), "chirp_other").otherwise(F.col("chirp_id")))


@query(f"""WITH {Q.BASE}, {Q.POSITIVE}, {_RENAMED} SELECT match_id FROM positives p LEFT JOIN renamed a ON p.anchor_sample_id = a.sample_id LEFT JOIN renamed c ON p.positive_sample_id = c.sample_id
  WHERE NOT coalesce(a.event_id = c.event_id AND a.chirp_id = c.chirp_id AND a.chirp_id <> '', false)""")
def audit_positive(spark, sf_dir):
    return audits.wrong_positives(pairs.positive_pairs(V.samples(spark, sf_dir)), renamed(spark, sf_dir)).select("match_id")


@query(f"""WITH {Q.BASE}, {Q.NEGATIVES}, {_RENAMED} SELECT negative_pair_id FROM negatives p LEFT JOIN renamed a ON p.anchor_sample_id = a.sample_id LEFT JOIN renamed c ON p.candidate_sample_id = c.sample_id
  WHERE a.sample_id IS NULL OR c.sample_id IS NULL OR CASE WHEN negative_type = 'invalid_delay_same_chirp' THEN coalesce(p.same_chirp <> 1, true)
        ELSE coalesce(a.chirp_id = c.chirp_id AND a.chirp_id <> '', false) END""")
def audit_negative(spark, sf_dir):
    s = samples_once(spark, sf_dir, *_FOR_PAIRS)
    return audits.wrong_negatives(pairs.drawn_negatives(s), audits.known_by_number(s, renamed(spark, sf_dir))).select("negative_pair_id")


def _counted(name: str, place: int, body: str) -> str:
    return f"SELECT {place}::BIGINT AS place, '{name}' AS check_name, count(*) AS violations FROM ({body})"


_ROLLUP = " UNION ALL ".join(
    (
        _counted("event_leakage", 0, _leaks("event_id")), _counted("chirp_leakage", 1, _leaks("chirp_id")), _counted("glitch_leakage", 2, _leaks("glitch_id", where="glitch_id <> ''")),
        _counted("source_group_leakage", 3, _leaks(_GROUP, where="glitch_id <> ''")), _counted("background_domain", 4, "SELECT 1 FROM domains WHERE with_glitch <> without_glitch"),
        _counted("background_group_leakage", 5, _leaks("background_source_group")),
        _counted("positive_pairs", 6, "SELECT 1 FROM positives p JOIN sample a ON p.anchor_sample_id = a.sample_id JOIN sample c ON p.positive_sample_id = c.sample_id WHERE a.chirp_id <> c.chirp_id"),
        _counted("match_pair_split", 7, "SELECT 1 FROM positives p JOIN sample a ON p.anchor_sample_id = a.sample_id WHERE a.split <> p.split"),
    )
)


@query(f"WITH {Q.BASE}, {Q.POSITIVE}, {_DOMAINS}, r AS ({_ROLLUP}) SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r")
def audit_rollup(spark, sf_dir):
    s = samples_once(spark, sf_dir)
    return audits.rollup(s, positives=pairs.positive_pairs(s))


#: Metadata with something wrong for every check.
_BAD = """bad AS (SELECT * REPLACE (
    CASE WHEN num % 3 = 0 AND detector = 'L1' THEN 'test' ELSE split END AS split,
    CASE WHEN num % 7 = 0 AND detector = 'L1' THEN 'chirp_other' ELSE chirp_id END AS chirp_id,
    CASE WHEN has_glitch = 1 AND num % 50 = 0 THEN 'unknown_noise' ELSE noise_type END AS noise_type) FROM sample WHERE num % 41 <> 0 OR detector <> 'H1')"""


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, second = F.col("num"), F.col("detector") == "L1"
    s = V.samples(spark, sf_dir).where("num % 41 <> 0 or detector <> 'H1'")
    s = s.withColumn("split", F.when((n % 3 == 0) & second, "test").otherwise(F.col("split"))).withColumn("chirp_id", F.when((n % 7 == 0) & second, "chirp_other").otherwise(F.col("chirp_id")))
    return s.withColumn("noise_type", F.when((F.col("has_glitch") == 1) & (n % 50 == 0), "unknown_noise").otherwise(F.col("noise_type")))


def _sides(pairs: str, other: str) -> str:
    return f"{pairs} p LEFT JOIN bad a ON p.anchor_sample_id = a.sample_id LEFT JOIN bad c ON p.{other} = c.sample_id"


_CROSSED = "a.split IS DISTINCT FROM p.split OR c.split IS DISTINCT FROM p.split"
_ROLLUP_BAD = " UNION ALL ".join(
    (
        _counted("event_leakage", 0, _leaks("event_id", "bad")), _counted("chirp_leakage", 1, _leaks("chirp_id", "bad")), _counted("glitch_leakage", 2, _leaks("glitch_id", "bad", "glitch_id <> ''")),
        _counted("source_group_leakage", 3, _leaks(_GROUP, "bad", "glitch_id <> ''")), _counted("background_domain", 4, "SELECT 1 FROM domains WHERE with_glitch <> without_glitch"),
        _counted("background_group_leakage", 5, _leaks("background_source_group", "bad")),
        _counted("positive_pairs", 6, f"SELECT 1 FROM {_sides('positives', 'positive_sample_id')} WHERE NOT coalesce(a.event_id = c.event_id AND a.chirp_id = c.chirp_id AND a.chirp_id <> '', false)"),
        _counted("negative_pairs", 7, f"""SELECT 1 FROM {_sides('negatives', 'candidate_sample_id')} WHERE a.sample_id IS NULL OR c.sample_id IS NULL
          OR CASE WHEN negative_type = 'invalid_delay_same_chirp' THEN coalesce(p.same_chirp <> 1, true) ELSE coalesce(a.chirp_id = c.chirp_id AND a.chirp_id <> '', false) END"""),
        _counted("match_pair_split", 8, f"SELECT 1 FROM {_sides('positives', 'positive_sample_id')} WHERE {_CROSSED}"),
        _counted("negative_pair_split", 9, f"SELECT 1 FROM {_sides('negatives', 'candidate_sample_id')} WHERE {_CROSSED}"),
        _counted("combined_pair_split", 10, f"SELECT 1 FROM {_sides('combined', 'candidate_sample_id')} WHERE {_CROSSED}"),
    )
)


@query(f"""WITH {Q.BASE}, {Q.POSITIVE}, {Q.NEGATIVES}, {Q.COMBINED}, {_BAD}, {_DOMAINS.replace('FROM sample)', 'FROM bad)')}, r AS ({_ROLLUP_BAD})
  SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def audit_rollup_leaky(spark, sf_dir):
    """All eleven checks, over metadata that breaks each of them."""
    s = samples_once(spark, sf_dir, *_FOR_PAIRS)
    return audits.rollup(bad_rows(spark, sf_dir), pairs.drawn_positives(s), pairs.drawn_negatives(s), samples=s)


@query(f"""WITH {SAMPLES}, used AS (SELECT split, glitch_id, {_GROUP} AS grp FROM sample WHERE glitch_id <> ''),
  uses AS (SELECT split, glitch_id, count(*) AS n FROM used GROUP BY ALL)
  SELECT split, sum(n)::BIGINT AS samples, count(*) AS unique_glitches, (SELECT count(DISTINCT grp) FROM used x WHERE x.split = uses.split) AS source_groups, max(n) AS most_uses FROM uses GROUP BY split""")
def manifest_per_split(spark, sf_dir):
    return audits.manifest(V.samples(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT sample_id, event_id, split, detector, global_class, glitch_id, glitch_type, glitch_gps, {_GROUP} AS glitch_source_group FROM sample WHERE has_glitch = 1")
def glitch_catalog_used(spark, sf_dir):
    return audits.glitches_used(V.samples(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT event_id, round(sqrt(sum(detector_snr * detector_snr)), 6) AS network_snr, count(*) AS detectors FROM sample GROUP BY event_id")
def network_snr(spark, sf_dir):
    return audits.network_snr(V.samples(spark, sf_dir)).select("event_id", *six("network_snr"), "detectors")


@query(f"""WITH {SAMPLES} SELECT a.sample_id, a.event_id, coalesce(string_agg(b.sample_id, ';' ORDER BY b.sample_id), '') AS counterpart_sample_ids
  FROM sample a LEFT JOIN sample b ON a.event_id = b.event_id AND a.sample_id <> b.sample_id GROUP BY a.sample_id, a.event_id""")
def counterparts(spark, sf_dir):
    return audits.counterparts(V.samples(spark, sf_dir))


# ----------------------------------------------------------------- draws and scalars
@query(f"WITH {SAMPLES} SELECT sample_id, global_class FROM sample QUALIFY row_number() OVER (PARTITION BY global_class ORDER BY md5({digest_key('viz', 'sample_id')}), sample_id) <= 20")
def stratified_sample(spark, sf_dir):
    """At most 20 samples per class (a sampling operator)."""
    s = V.samples(spark, sf_dir).select("sample_id", "global_class").withColumn("__h", draws.rank_hash("viz", F.col("sample_id"))).withColumn("gps", F.lit(0.0))
    return groups.capped(s, ["global_class"], [F.col("__h"), F.col("sample_id")], 20).select("sample_id", "global_class")


@query(f"WITH {EVENTS} SELECT signal_type, snr_bin, count(*) AS n, round(min(target_snr), 6) AS low, round(max(target_snr), 6) AS high FROM astro_event WHERE has_chirp = 1 GROUP BY ALL")
def weighted_snr_bin(spark, sf_dir):
    e = V.astro_events(spark, sf_dir).where("has_chirp = 1")
    return e.groupBy("signal_type", "snr_bin").agg(F.count("*").alias("n"), F.round(F.min("target_snr"), 6).alias("low"), F.round(F.max("target_snr"), 6).alias("high"))


_M1, _M2 = f"(15.0::DOUBLE + {u('m1', 'num')} * 45.0::DOUBLE)", f"(15.0::DOUBLE + {u('m2', 'num')} * ((15.0::DOUBLE + {u('m1', 'num')} * 45.0::DOUBLE) - 15.0::DOUBLE))"
_S1, _S2 = (f"(-0.8::DOUBLE + {u(k, 'num')} * 1.6::DOUBLE)" for k in ("s1", "s2"))


@query(f"""WITH m AS (SELECT o_orderkey AS num FROM orders), p AS (SELECT num, {_M1} AS m1, {_M2} AS m2, {_S1} AS s1, {_S2} AS s2 FROM m)
  SELECT num, round(pow(m1 * m2, 0.6::DOUBLE) / pow(m1 + m2, 0.2::DOUBLE), 6) AS chirp_mass, round(m1 + m2, 6) AS total_mass,
         round(least(m1, m2) / greatest(m1, m2), 6) AS mass_ratio, round((m1 * s1 + m2 * s2) / (m1 + m2), 6) AS chi_eff FROM p""")
def derived_params(spark, sf_dir):
    n = F.col("num")
    p = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num")).withColumn("m1", draws.uniform("m1", 15.0, 60.0, n))
    p = p.withColumn("m2", draws.uniform("m2", 15.0, F.col("m1"), n)).withColumn("s1", -0.8 + draws.u("s1", n) * 1.6).withColumn("s2", -0.8 + draws.u("s2", n) * 1.6)
    m1, m2 = F.col("m1"), F.col("m2")
    out = p.select("num", S.chirp_mass(m1, m2).alias("chirp_mass"), (m1 + m2).alias("total_mass"), S.mass_ratio(m1, m2).alias("mass_ratio"), S.chi_eff(m1, m2, F.col("s1"), F.col("s2")).alias("chi_eff"))
    return out.select("num", *six("chirp_mass", "total_mass", "mass_ratio", "chi_eff"))


_UNIT = "least(greatest((ln(greatest({f}, 1e-9)) - ln(20.0::DOUBLE)) / (ln(1000.0::DOUBLE) - ln(20.0::DOUBLE)), 0.0), 1.0)"


@query(f"""WITH {POOL}, f AS (SELECT ord, snr + 15 AS f FROM pool) SELECT ord, round({_UNIT.format(f='f')}, 6) AS unit_log, round(least(greatest(f / 1000.0::DOUBLE, 0), 1), 6) AS unit_linear,
  round(exp(ln(20.0::DOUBLE) + {_UNIT.format(f='f')} * (ln(1000.0::DOUBLE) - ln(20.0::DOUBLE))), 6) AS back FROM f""")
def freq_axis_map(spark, sf_dir):
    f = V.pool(spark, sf_dir).select("ord", (F.col("snr") + 15).alias("f"))
    unit = S.freq_to_unit(F.col("f"))
    return f.select("ord", F.round(unit, 6).alias("unit_log"), F.round(S.freq_to_unit(F.col("f"), 0.0, 1000.0, "linear"), 6).alias("unit_linear"), F.round(S.unit_to_freq(unit), 6).alias("back"))


_BOX = f"""box AS (SELECT sample_id, CASE WHEN has_chirp = 1 THEN least(greatest(injection_time - 0.4::DOUBLE, 0), 4) END AS t0, least(greatest(injection_time, 0), 4) AS t1,
  {_UNIT.format(f='label_low')} AS a, {_UNIT.format(f='label_high')} AS b FROM sample)"""


def _boxes(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    box = S.chirp_box(F.col("injection_time") - 0.4, F.col("injection_time"), F.col("label_low"), F.col("label_high"))
    return s.where("has_chirp = 1").select("sample_id", box.alias("box"))


@query(f"""WITH {SAMPLES}, {_BOX} SELECT sample_id, 0 AS class_id, round((t0 + t1) / 2 / 4.0::DOUBLE, 6) AS cx, round(1 - (a + b) / 2, 6) AS cy, round((t1 - t0) / 4.0::DOUBLE, 6) AS w,
  round(abs(b - a), 6) AS h, round((t1 - t0) / 4.0::DOUBLE * greatest(b - a, 0), 6) AS area FROM box WHERE t0 IS NOT NULL""")
def yolo_encode(spark, sf_dir):
    y = _boxes(spark, sf_dir).select("sample_id", S.yolo(F.col("box")).alias("y"), S.box_area(F.col("box")).alias("area"))
    return y.select("sample_id", "y.class_id", *[F.round(f"y.{k}", 6).alias(k) for k in ("cx", "cy", "w", "h")], F.round("area", 6).alias("area"))


@query("""WITH l AS (SELECT event_id, '  ' || CASE WHEN event_id % 11 = 0 THEN '1.0' ELSE (event_id % 3)::VARCHAR END || ' ' || (value / 1000) || '  0.5 ' || (value / 7000) || ' '
    || CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 7 = 0 THEN '0.1 9' ELSE '.125e0' END AS line FROM events),
  t AS (SELECT event_id, string_split_regex(trim(line), '\\s+') AS t FROM l),
  n AS (SELECT event_id, t, [TRY_CAST(x AS DOUBLE) for x in t] AS v FROM t)
  SELECT event_id, v[1]::INT AS class_id, round(v[2], 6) AS cx, v[3] AS cy, round(v[4], 6) AS w, v[5] AS h FROM n
  WHERE len(t) = 5 AND regexp_full_match(t[1], '[+-]?[0-9]+') AND len(list_filter(v, lambda x: x IS NULL)) = 0""")
def yolo_parse(spark, sf_dir):
    e, n = V.table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(n % 11 == 0, "1.0").otherwise((n % 3).cast("string"))
    tail = F.when(n % 5 == 0, "x").when(n % 7 == 0, "0.1 9").otherwise(".125e0")
    line = F.concat(F.lit("  "), kind, F.lit(" "), (F.col("value") / 1000).cast("string"), F.lit("  0.5 "), (F.col("value") / 7000).cast("string"), F.lit(" "), tail)
    b = e.select("event_id", S.parse_yolo(line).alias("b")).where("b is not null")
    return b.select("event_id", "b.class_id", F.round("b.cx", 6).alias("cx"), "b.cy", F.round("b.w", 6).alias("w"), "b.h")


@query(f"""WITH {SAMPLES}, {_BOX},
  y AS (SELECT sample_id, (t0 + t1) / 2 / 4.0::DOUBLE AS cx, 1 - (a + b) / 2 AS cy, (t1 - t0) / 4.0::DOUBLE AS w, abs(b - a) AS h, {u('label', 'sample_id')} * 0.04::DOUBLE AS s, {u('lost', 'sample_id')} < 0.1 AS lost FROM box WHERE t0 IS NOT NULL),
  labels AS (SELECT sample_id, cx + s AS x, cy AS y, w, h FROM y WHERE NOT lost UNION ALL SELECT sample_id, cx, cy - 0.03::DOUBLE + s, w, h + s / 4 FROM y WHERE NOT lost UNION ALL SELECT sample_id, cx, cy, w + 0.5::DOUBLE, h FROM y WHERE NOT lost),
  gaps AS (SELECT y.sample_id, greatest(abs(l.x - y.cx), abs(l.y - y.cy), abs(l.w - y.w), abs(l.h - y.h)) AS gap FROM y JOIN labels l ON l.sample_id = y.sample_id)
  SELECT y.sample_id, coalesce(min(gap) > 0.01::DOUBLE, true)::INT AS mismatch FROM y LEFT JOIN gaps g ON g.sample_id = y.sample_id GROUP BY y.sample_id""")
def box_mismatch(spark, sf_dir):
    """Whether the nearest of three label boxes, or none where the labels are lost, is off."""
    y = _boxes(spark, sf_dir).select("sample_id", S.yolo(F.col("box")).alias("y"))
    s = draws.u("label", F.col("sample_id")) * 0.04

    def label(**moved):
        return F.struct(F.lit(0).alias("class_id"), *[(F.col(f"y.{k}") + moved.get(k, F.lit(0.0))).alias(k) for k in ("cx", "cy", "w", "h")])

    every = F.array(label(cx=s), label(cy=s - 0.03, h=s / 4), label(w=F.lit(0.5)))
    labels = F.when(draws.u("lost", F.col("sample_id")) < 0.1, F.slice(every, 1, 0)).otherwise(every)
    return y.select("sample_id", A.box_mismatch(F.col("y"), labels).cast("int").alias("mismatch"))


# ----------------------------------------------------------------- arrays
_STATS = f"""WITH {CELLS}, med AS (SELECT id, quantile_cont(energy, 0.5) AS median FROM cells GROUP BY id),
  st AS (SELECT c.id, any_value(median) AS median, quantile_cont(abs(energy - median), 0.5) AS mad, stddev_pop(energy) AS std, quantile_cont(energy, 0.995) AS p995, max(energy) AS peak, avg(energy) AS mean, count(*) AS n
    FROM cells c JOIN med USING (id) GROUP BY c.id)"""


@query(f"""{_STATS} SELECT id, round(median, 6) AS median, round(mad, 6) AS mad, round(std, 6) AS std, round(p995, 6) AS p995, round(peak, 6) AS peak, round(mean, 6) AS mean, n,
  round(CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE std END, 6) AS sigma FROM st""")
def robust_stats(spark, sf_dir):
    r = A.robust(V.cells(spark, sf_dir), "id", "energy")
    return r.select("id", *six("median", "mad", "std", "p995", "peak", "mean"), "n", *six("sigma"))


def _squares(spark, sf_dir):
    return V.series(spark, sf_dir).select("id", F.transform("x", lambda v: v * v).alias("e"))


def _summed(rows: DataFrame) -> DataFrame:
    total = F.aggregate("energy", F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", F.round("energy_peak", 4).alias("energy_peak"), F.round(total, 4).alias("energy_sum"), F.size(F.filter("energy", lambda v: v >= 24.999999)).cast("bigint").alias("clipped"))


_NORMED = "SELECT id, round(max(s), 4) AS energy_peak, round(sum(least(greatest(s, 0), 25)), 4) AS energy_sum, count(*) FILTER (WHERE s >= 24.999999) AS clipped FROM z GROUP BY id"


@query(f"{_STATS}, z AS (SELECT c.id, energy / CASE WHEN p995 > 0 THEN p995 WHEN peak <> 0 THEN peak ELSE 1 END * 25 AS s FROM cells c JOIN st USING (id)) {_NORMED}")
def energy_percentile_norm(spark, sf_dir):
    return _summed(A.normalized(_squares(spark, sf_dir), "e"))


@query(f"{_STATS}, z AS (SELECT c.id, greatest((energy - median) / CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE std + 1e-12 END, 0) / 6.0::DOUBLE * 25 AS s FROM cells c JOIN st USING (id)) {_NORMED}")
def energy_mad_norm(spark, sf_dir):
    return _summed(A.normalized(_squares(spark, sf_dir), "e", "mad"))


@query(f"WITH {CELLS} SELECT id, count(*) FILTER (WHERE energy >= 0.03) AS loud, (count(*) FILTER (WHERE energy >= 0.03) <= 12)::INT AS accepted FROM cells GROUP BY id")
def veto_loud_pixels(spark, sf_dir):
    loud = A.loud_pixels(F.col("e"), 0.03)
    return _squares(spark, sf_dir).select("id", loud.cast("bigint").alias("loud"), (loud <= 12).cast("int").alias("accepted"))


@query(f"""WITH {CELLS}, pk AS (SELECT id, max(energy) AS peak FROM cells GROUP BY id),
  seg AS (SELECT c.id, count(*) FILTER (WHERE energy >= 0.03) AS loud,
    (max(r) FILTER (WHERE energy >= peak * 0.3::DOUBLE) - min(r) FILTER (WHERE energy >= peak * 0.3::DOUBLE) + 1) * (max(c) FILTER (WHERE energy >= peak * 0.3::DOUBLE) - min(c) FILTER (WHERE energy >= peak * 0.3::DOUBLE) + 1) / 64.0::DOUBLE AS area
    FROM cells c JOIN pk USING (id) WHERE peak > 0 GROUP BY c.id),
  tried AS (SELECT o_orderkey AS num, t.k AS attempt, floor({u('segment', 'o_orderkey', 't.k')} * (SELECT count(*) FROM embeddings))::BIGINT AS id FROM orders, range(12) t(k))
  SELECT num, min(attempt)::INT AS attempt, arg_min(t.id, attempt) AS id FROM tried t JOIN seg s ON s.id = t.id WHERE loud <= 8 AND area <= 0.6::DOUBLE GROUP BY num""")
def segment_accept(spark, sf_dir):
    """The first of twelve drawn segments that is quiet enough and whose ridge box is small enough."""
    cells = V.cells(spark, sf_dir)
    box = A.ridge_bounds(cells, "id").withColumn("area", (F.col("r_max") - F.col("r_min") + 1) * (F.col("c_max") - F.col("c_min") + 1) / 64.0)
    loud = cells.groupBy("id").agg(F.count(F.when(F.col("energy") >= 0.03, 1)).alias("loud"))
    judged = box.join(loud, "id").select("id", ((F.col("loud") <= 8) & (F.col("area") <= 0.6)).alias("accepted"))
    size = V.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("size"))

    def evaluate(tried: DataFrame) -> DataFrame:
        drawn = tried.join(F.broadcast(size)).withColumn("id", F.floor(draws.u("segment", F.col("num"), F.col("attempt")) * F.col("size")).cast("bigint"))
        return drawn.join(judged, "id").select("num", "attempt", "id", "accepted")

    return groups.first_accepted(_numbers(spark, sf_dir), 12, evaluate, ["id"]).where("attempt is not null")


@query(f"WITH {CELLS} SELECT id, round(avg(energy) FILTER (WHERE c BETWEEN 2 AND 5) / nullif(avg(energy) FILTER (WHERE c NOT BETWEEN 2 AND 5), 0), 6) AS ratio FROM cells WHERE r <= 3 GROUP BY id")
def pedestal_ratio(spark, sf_dir):
    high = V.cells(spark, sf_dir).where("r <= 3")
    return A.pedestal_ratio(high, "id", F.col("c").between(2, 5)).select("id", *six("ratio"))


@query(f"""WITH {CELLS}, pk AS (SELECT id, max(energy) AS peak FROM cells GROUP BY id)
  SELECT c.id, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max, count(*) AS hot FROM cells c JOIN pk USING (id) WHERE peak > 0 AND energy >= peak * 0.3::DOUBLE GROUP BY c.id""")
def ridge_box_minmax(spark, sf_dir):
    return A.ridge_bounds(V.cells(spark, sf_dir), "id")


def _axis(a: str) -> str:
    return f"""{a}p AS (SELECT id, {a}, sum(energy) AS mass FROM hot GROUP BY id, {a}),
  {a}c AS (SELECT id, {a}, round(sum(mass) OVER (PARTITION BY id ORDER BY {a}), 12) AS cum, round(sum(mass) OVER (PARTITION BY id), 12) AS total FROM {a}p),
  {a}b AS (SELECT id, min({a}) FILTER (WHERE cum >= round(total * 0.01::DOUBLE, 12)) AS {a}_low, coalesce(min({a}) FILTER (WHERE cum >= round(total * 0.99::DOUBLE, 12)), max({a})) AS {a}_high FROM {a}c GROUP BY id)"""


@query(f"""WITH {CELLS}, lim AS (SELECT id, greatest(max(energy) * 0.3::DOUBLE, quantile_cont(energy, 0.5) * 5.0::DOUBLE) AS lim, max(energy) AS peak FROM cells GROUP BY id),
  hot AS (SELECT c.* FROM cells c JOIN lim USING (id) WHERE peak > 0 AND energy >= lim), {_axis('r')}, {_axis('c')}
  SELECT id, r_low, r_high, c_low, c_high FROM rb JOIN cb USING (id)""")
def ridge_box_mass_quantile(spark, sf_dir):
    return A.mass_bounds(V.cells(spark, sf_dir), "id").select("id", "r_low", "r_high", "c_low", "c_high")


@query(f"""WITH {SERIES}, pts AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v, len(x) AS n FROM series), ks AS (SELECT unnest(range(33)) AS k)
  SELECT id, k, round(pow(sum(v * cos(-2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(v * sin(-2 * pi() * ((k * i) % n) / n)), 2), 4) AS power FROM pts, ks GROUP BY id, k""")
def dft_power(spark, sf_dir):
    return A.dft_power(V.series(spark, sf_dir), "id", "x").select("id", "k", F.round("power", 4).alias("power"))




# ------------------------------------------------ kernels (checked in the tests; no SQL)
@query(f"""WITH {SERIES}, pts AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM series), ks AS (SELECT unnest(range(4, 17)) AS k),
  dft AS (SELECT id, k, sum(v * cos(-2 * pi() * ((k * i) % 64) / 64)) AS re, sum(v * sin(-2 * pi() * ((k * i) % 64) / 64)) AS im FROM pts, ks GROUP BY id, k),
  kept AS (SELECT id, 2 * sum(re * re + im * im) / 64 AS power FROM dft GROUP BY id)
  SELECT p.id, round(sum(v * v), 6) AS power_in, round(any_value(power), 6) AS power_out FROM pts p JOIN kept k ON k.id = p.id GROUP BY p.id""")
def bandlimit_fft(spark, sf_dir):
    s = V.series(spark, sf_dir).select("id", synthesis.bandlimited(F.col("x"), 64.0, 4.0, 16.0).alias("y"), "x")
    power = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v * v), 6)
    return s.select("id", power("x").alias("power_in"), power("y").alias("power_out"))


def _tiles_sql(n: int = 64, rate: float = 64.0, q: float = 4.0, low: float = 4.0, high: float = 20.0) -> str:
    """One plane by sums: each tile is the windowed stretch of the spectrum around its row, brought back to its time."""
    rows = qscan.plane_rows(n, rate, q, low, high)
    values = ", ".join(f"({r.centre}, {r.reach!r}::DOUBLE, {r.tiles})" for r in rows)
    return f"""WITH {SERIES}, pts AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM series), ks AS (SELECT unnest(range({n // 2 + 1})) AS k),
  dft AS (SELECT id, k, sum(v * cos(-2 * pi() * ((k * i) % {n}) / {n})) AS re, sum(v * sin(-2 * pi() * ((k * i) % {n}) / {n})) AS im FROM pts, ks GROUP BY id, k),
  lines(centre, reach, tiles) AS (VALUES {values}),
  windows AS (SELECT centre, tiles, k, pow(1 - pow((k - centre) / reach, 2), 2) AS w FROM lines JOIN ks ON abs(k - centre) < reach),
  turned AS (SELECT centre, tiles, k, t, w * cos(2 * pi() * ((k * t) % tiles) / tiles) AS c, w * sin(2 * pi() * ((k * t) % tiles) / tiles) AS s FROM (SELECT *, unnest(range(tiles)) AS t FROM windows)),
  waves AS (SELECT id, centre, t, sum(re * c - im * s) AS a, sum(re * s + im * c) AS b FROM dft JOIN turned USING (k) GROUP BY ALL),
  tile AS (SELECT id, centre, t, a * a + b * b AS energy, quantile_cont(a * a + b * b, 0.5) OVER (PARTITION BY id, centre) AS middle FROM waves)
  SELECT id, centre * {rate / n}::DOUBLE AS frequency, t::INT AS tile, round(CASE WHEN middle > 0 THEN energy / middle ELSE 0 END, 4) AS energy FROM tile"""


@query(_tiles_sql())
def q_tiles(spark, sf_dir):
    """The tiles of one Q of each series, over the median of their row."""
    rows = synthesis.tile_energies(V.series(spark, sf_dir), "id", "x", 64.0, 4.0, 4.0, 20.0)
    return rows.select("id", "frequency", F.posexplode("energies").alias("tile", "energy")).withColumn("energy", F.round("energy", 4))


@query()
def cqt_energy(spark, sf_dir):
    got = synthesis.energy_summary(V.series(spark, sf_dir), "id", "x", 4096.0, 16, 16)
    return got.select("id", *six("peak", "mean"), "row", "col")


@query()
def chirp_track(spark, sf_dir):
    return synthesis.tracks(V.series(spark, sf_dir), "id", "x", 64.0).select("id", *six("t_start", "t_end", "f_low", "f_high"))


def _numbers(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num"))


@query()
def inject_snr(spark, sf_dir):
    """The SNR that injections reach against what was asked for, per event of the orders table."""
    m = synthesis.build_samples(_numbers(spark, sf_dir), DEFAULT, energy=False).where("has_chirp = 1")
    return m.select("sample_id", *six("target_snr", "detector_snr", "network_snr"), "snr_bin")


@query()
def synth_noise_stats(spark, sf_dir):
    m = synthesis.build_samples(_numbers(spark, sf_dir), DEFAULT)
    return m.groupBy("split", "detector", "global_class").agg(F.count("*").alias("n"), F.round(F.avg("energy_peak"), 4).alias("mean_peak"), F.sum("num_boxes").alias("boxes"))


@query()
def sample_table_build(spark, sf_dir):
    return synthesis.build_samples(_numbers(spark, sf_dir), DEFAULT).drop("boxes")


@query()
def event_table_build(spark, sf_dir):
    return synthesis.event_table(synthesis.build_samples(_numbers(spark, sf_dir), DEFAULT, energy=False))


@query(f"WITH {POOL} SELECT ifo, fid, count(*) AS n FROM gpool GROUP BY ifo, fid")
def stream_group_counts(spark, sf_dir):
    where = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    return stream.run_counts(spark, f"{sf_dir}/events.parquet", f"{where}/checkpoint", f"{where}/counts")
