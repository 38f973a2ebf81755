"""The views of ``sources.views`` in DuckDB's SQL, as common table expressions."""

from __future__ import annotations

from chirplake.config import GLOBAL_CLASSES, SNR_BINS, SNR_WEIGHTS


def u(salt: str, *keys: str) -> str:
    return f"(('0x' || substr(md5({digest_key(salt, *keys)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def digest_key(salt: str, *keys: str) -> str:
    return "concat_ws('|', '42', '" + salt + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + ")"


def choice(salt: str, values: tuple[str, ...], *keys: str) -> str:
    return f"(['{"', '".join(values)}'])[floor({u(salt, *keys)} * {len(values)})::BIGINT + 1]"


def _weighted(draw: str) -> str:
    total, out = 0.0, "CASE"
    names = list(SNR_WEIGHTS)
    for name in names[:-1]:
        total = round(total + SNR_WEIGHTS[name], 9)
        out += f" WHEN {draw} < {total}::DOUBLE THEN '{name}'"
    return f"{out} ELSE '{names[-1]}' END"


def _edge(end: int) -> str:
    rows = " ".join(f"WHEN signal_type = '{k}' AND snr_bin = '{b}' THEN {x[end]}::DOUBLE" for k, bins in SNR_BINS.items() for b, x in bins.items())
    return f"CASE {rows} END"


POOL = """pool AS (
  SELECT event_id AS ord, CASE WHEN user_id % 2 = 0 THEN 'H1' ELSE 'L1' END AS ifo, epoch_us(ts) / 1e6::DOUBLE AS gps,
         event_type AS label, value AS snr FROM events),
gpool AS (SELECT *, floor(gps / 4096)::BIGINT AS fid, ifo || ':' || floor(gps / 4096)::BIGINT::VARCHAR AS grp FROM pool)"""

SIZES = """quota AS (
  SELECT name, place, ratio, floor(n * ratio)::BIGINT AS base, n * ratio - floor(n * ratio) AS rest, n
  FROM (VALUES ('train', 0, 0.70::DOUBLE), ('val', 1, 0.15::DOUBLE), ('test', 2, 0.15::DOUBLE)) v(name, place, ratio),
       (SELECT count(*) AS n FROM orders)),
sizes AS (
  SELECT name, place, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, ratio DESC, place) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS size FROM quota),
bounds AS (SELECT name, place, sum(size) OVER (ORDER BY place) AS upto, size FROM sizes)"""

_CLASSES = "['" + "', '".join(GLOBAL_CLASSES) + "']"

EVENTS = f"""{SIZES},
raw_event AS (
  SELECT o_orderkey AS num, ({_CLASSES})[o_orderkey % 6 + 1] AS global_class,
         row_number() OVER (ORDER BY md5({digest_key('split', 'o_orderkey')}), o_orderkey) AS rnk FROM orders),
typed AS (
  SELECT num, global_class, rnk,
         CASE WHEN global_class LIKE 'bbh%' THEN 'BBH' WHEN global_class LIKE 'bns%' THEN 'BNS' ELSE 'None' END AS signal_type,
         (global_class NOT IN ('glitch_only', 'pure_noise'))::INT AS has_chirp, (global_class LIKE '%glitch%')::INT AS has_glitch FROM raw_event),
binned AS (
  SELECT t.*, (SELECT name FROM bounds b WHERE t.rnk <= b.upto ORDER BY place LIMIT 1) AS split,
         printf('evt_%06d', num) AS event_id, CASE WHEN has_chirp = 1 THEN printf('chirp_%06d', num) END AS chirp_id,
         CASE WHEN has_chirp = 1 THEN {_weighted(u('snr_bin', 'num'))} END AS snr_bin FROM typed t),
astro_event AS (
  SELECT *, CASE WHEN has_chirp = 1 THEN {_edge(0)} + {u('snr', 'num')} * ({_edge(1)} - {_edge(0)}) END AS target_snr,
         1.0::DOUBLE + {u('time', 'num')} * 2.0::DOUBLE AS event_time,
         CASE WHEN has_chirp = 1 THEN 20.0::DOUBLE + {u('flo', 'num')} * 60.0::DOUBLE END AS label_low,
         CASE WHEN has_chirp = 1 THEN 20.0::DOUBLE + {u('flo', 'num')} * 60.0::DOUBLE + 40.0::DOUBLE + {u('fhi', 'num')} * 260.0::DOUBLE END AS label_high
  FROM binned)"""

_DELAY = f"(({u('delay', 'num', 'detector')} * 2.0::DOUBLE - 1.0::DOUBLE) * 0.01::DOUBLE)"
_PICK = f"floor({u('glitch', 'num', 'detector')} * 4000)::BIGINT"

SAMPLES = f"""{EVENTS},
dets AS (SELECT 0 AS d, 'H1' AS detector UNION ALL SELECT 1, 'L1'),
sample0 AS (SELECT e.*, d, detector, {_PICK} AS pick, {u('noise', 'num', 'detector')} < 0.5 AS realnoise FROM astro_event e, dets),
sample AS (
  SELECT *, num * 2 + d AS ord, printf('%s_%06d_%s', split, num, detector) AS sample_id,
         CASE WHEN has_chirp = 1 THEN {_DELAY} END AS time_delay,
         CASE WHEN has_chirp = 1 THEN event_time + {_DELAY} END AS injection_time,
         CASE WHEN has_chirp = 1 THEN target_snr * (1.0::DOUBLE + ({u('snr_jitter', 'num', 'detector')} * 2.0::DOUBLE - 1.0::DOUBLE) * 0.15::DOUBLE) END AS detector_snr,
         printf('noise_%08d', num * 2 + d) AS noise_id,
         CASE WHEN realnoise THEN 'real_gwosc_offsource' ELSE 'gaussian_aligo_colored' END AS noise_type,
         NULL::VARCHAR AS background_source,
         CASE WHEN realnoise THEN detector || ':' || floor({u('background', 'num', 'detector')} * 5000)::BIGINT::VARCHAR END AS background_source_group,
         CASE WHEN has_glitch = 1 THEN printf('glitch_%08d', pick) END AS glitch_id,
         CASE WHEN has_glitch = 1 THEN 1260000000.0::DOUBLE + pick * 997.0::DOUBLE END AS glitch_gps,
         CASE WHEN has_glitch = 1 THEN {choice('glitch_type', ('Blip', 'Tomte', 'Whistle'), 'pick')} END AS glitch_type,
         CASE WHEN has_glitch = 1 AND pick % 3 = 0 THEN detector || ':' || floor((1260000000.0::DOUBLE + pick * 997.0::DOUBLE) / 4096)::BIGINT::VARCHAR END AS glitch_source_group
  FROM sample0)"""

SERIES = "series AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings)"
CELLS = f"""{SERIES},
points AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM series),
cells AS (SELECT id, i, i // 8 AS r, i % 8 AS c, v * v AS energy FROM points)"""
