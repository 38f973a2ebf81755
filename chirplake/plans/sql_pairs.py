"""The pair operators in DuckDB's SQL."""

from __future__ import annotations

from chirplake.config import EASY_TYPES, HARD_TYPES
from chirplake.plans.sql_views import SAMPLES, digest_key, u

_FIELDS = ("sample_id", "event_id", "chirp_id", "detector", "snr_bin", "label_low", "label_high", "injection_time")
_PLACE = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"

BASE = f"""{SAMPLES},
chirps AS (SELECT * FROM sample WHERE has_chirp = 1),
noises AS (SELECT * FROM sample WHERE global_class = 'pure_noise'),
only1 AS (SELECT split, max((global_class = 'glitch_only')::INT) AS yes FROM sample GROUP BY split),
glitches AS (
  SELECT s.* FROM sample s JOIN only1 USING (split)
  WHERE CASE WHEN yes = 1 THEN global_class = 'glitch_only' ELSE has_glitch = 1 AND has_chirp = 0 END)"""

POSITIVE = f"""positives AS (
  SELECT row_number() OVER (ORDER BY {_PLACE.replace('split', 'a.split')}, a.ord, b.ord) AS match_id, a.event_id, a.chirp_id, a.split,
         a.sample_id AS anchor_sample_id, b.sample_id AS positive_sample_id, a.detector AS anchor_detector, b.detector AS positive_detector,
         1 AS same_chirp, 0 AS same_noise
  FROM chirps a JOIN chirps b ON a.split = b.split AND a.event_id = b.event_id AND a.ord < b.ord)"""


def iou(a: str, b: str) -> str:
    al, ah, bl, bh = f"{a}label_low", f"{a}label_high", f"{b}label_low", f"{b}label_high"
    return (
        f"CASE WHEN {al} IS NOT NULL AND {ah} IS NOT NULL AND {bl} IS NOT NULL AND {bh} IS NOT NULL AND greatest({ah}, {bh}) - least({al}, {bl}) > 0 "
        f"THEN greatest(0.0::DOUBLE, least({ah}, {bh}) - greatest({al}, {bl})) / (greatest({ah}, {bh}) - least({al}, {bl})) ELSE 0.0::DOUBLE END"
    )


_SOURCES = {
    "different_chirp_cross_detector": ("chirps", ("split", "detector"), "event_id"),
    "same_detector_different_event": ("(SELECT * FROM chirps UNION ALL SELECT * FROM noises UNION ALL SELECT * FROM glitches)", ("split", "detector"), "event_id"),
    "chirp_vs_glitch": ("glitches", ("split",), "event_id"),
    "chirp_vs_noise": ("noises", ("split",), "event_id"),
    "similar_snr_different_chirp": ("chirps", ("split", "snr_bin"), "chirp_id"),
    "similar_frequency_different_chirp": ("chirps", ("split",), "chirp_id"),
}


def _described(kind: str) -> str:
    forced = kind == "invalid_delay_same_chirp"
    difference = "0.096::DOUBLE" if forced else "abs(a.injection_time - c.injection_time)"
    valid = "0" if forced else f"coalesce({difference} <= 0.012::DOUBLE, false)::INT"
    return f"""a.split, a.ord AS a_ord, a.slot, a.sample_id AS anchor_sample_id, c.sample_id AS candidate_sample_id,
         a.event_id AS anchor_event_id, c.event_id AS candidate_event_id, a.chirp_id AS anchor_chirp_id, c.chirp_id AS candidate_chirp_id,
         a.detector AS anchor_detector, c.detector AS candidate_detector, coalesce(a.chirp_id = c.chirp_id, false)::INT AS same_chirp,
         (a.event_id = c.event_id)::INT AS same_event, {valid} AS valid_time_delay, round({difference}, 6) AS time_delay_difference,
         round({iou('a.', 'c.')}, 6) AS frequency_overlap_score, a.snr_bin AS snr_bin_anchor, c.snr_bin AS snr_bin_candidate, '{kind}' AS negative_type"""


def pick(kind: str, anchors: str, name: str) -> str:
    """CTEs that end with ``name``: one candidate of the type for each row of ``anchors``."""
    t = name
    if kind == "invalid_delay_same_chirp":
        return f"""{t} AS (
  SELECT {_described(kind)} FROM {anchors} a JOIN chirps c ON a.split = c.split AND a.chirp_id = c.chirp_id AND a.sample_id <> c.sample_id
  QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.slot ORDER BY c.ord)
        = floor({u(kind, 'a.sample_id', 'a.slot')} * count(*) OVER (PARTITION BY a.sample_id, a.slot)) + 1)"""
    source, keys, apart = _SOURCES[kind]
    key = ", ".join(keys)
    pool = f"{t}_pool AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) - 1 AS idx FROM {source} q)"
    if kind == "similar_frequency_different_chirp":
        match = f"a.chirp_id <> c.chirp_id AND {iou('a.', 'c.')} > 0.3"
        width = "greatest({0}label_high - {0}label_low, 1e-6)"
        look, first = "(greatest(label_high - label_low, 1e-6) {op} 0.3::DOUBLE)", "QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.slot ORDER BY a.attempt) = 1"
        reach = "(greatest(label_high - label_low, 1e-6) + pow(2.0::DOUBLE, k + 1)) / 2"
        middle = "(label_low + label_high) / 2"
        return f"""{pool}, {t}_size AS (SELECT {key}, count(*) AS n FROM {t}_pool GROUP BY {key}),
{t}_try AS (
  SELECT a.*, t.attempt, floor({u('similar_frequency', 'a.sample_id', 'a.slot', 't.attempt')} * n)::BIGINT AS want
  FROM {anchors} a JOIN {t}_size USING (split), range(4) t(attempt)),
{t}_met AS (SELECT {_described(kind)} FROM {t}_try a JOIN {t}_pool c ON a.split = c.split AND a.want = c.idx WHERE {match} {first}),
{t}_rest AS (SELECT a.* FROM {anchors} a ANTI JOIN {t}_met m ON a.sample_id = m.anchor_sample_id AND a.slot = m.slot),
{t}_kind AS (SELECT *, floor(log2({width.format('')}))::INT AS k FROM {t}_pool WHERE label_high >= label_low),
{t}_spot AS (SELECT *, floor({middle} / pow(2.0::DOUBLE, k))::BIGINT AS p FROM {t}_kind),
{t}_known AS (SELECT *, row_number() OVER (PARTITION BY split, k, p ORDER BY idx) - 1 AS at FROM {t}_spot),
{t}_count AS (SELECT split, k, p, count(*) AS n FROM {t}_known GROUP BY ALL),
{t}_classes AS (SELECT *, unnest(range(floor(log2({look.format(op='*')}))::BIGINT, floor(log2({look.format(op='/')}))::BIGINT + 1))::INT AS k FROM {t}_rest WHERE label_high >= label_low),
{t}_cells AS (SELECT sample_id, slot, split, k, unnest(range(floor(({middle} - {reach}) / pow(2.0::DOUBLE, k))::BIGINT, floor(({middle} + {reach}) / pow(2.0::DOUBLE, k))::BIGINT + 1)) AS p FROM {t}_classes),
{t}_sums AS (
  SELECT sample_id, slot, k, p, n, sum(n) OVER (PARTITION BY sample_id, slot ORDER BY k, p) - n AS before, sum(n) OVER (PARTITION BY sample_id, slot) AS total
  FROM {t}_cells JOIN {t}_count USING (split, k, p)),
{t}_drawn AS (
  SELECT s.sample_id, s.slot, t.attempt, s.k, s.p, floor({u('similar_frequency_cell', 's.sample_id', 's.slot', 't.attempt')} * total)::BIGINT - before AS at, s.n
  FROM {t}_sums s, range(24) t(attempt)),
{t}_again AS (SELECT a.*, d.attempt, d.k, d.p, d.at FROM {t}_rest a JOIN {t}_drawn d ON a.sample_id = d.sample_id AND a.slot = d.slot WHERE d.at >= 0 AND d.at < d.n),
{t}_near AS (SELECT {_described(kind)} FROM {t}_again a JOIN {t}_known c ON a.split = c.split AND a.k = c.k AND a.p = c.p AND a.at = c.at WHERE {match} {first}),
{t}_last AS (SELECT a.* FROM {t}_rest a ANTI JOIN {t}_near m ON a.sample_id = m.anchor_sample_id AND a.slot = m.slot),
{t}_exact AS (
  SELECT {_described(kind)} FROM {t}_last a JOIN {t}_pool c ON a.split = c.split AND {match}
  QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.slot ORDER BY md5({digest_key('similar_frequency_exact', 'a.sample_id', 'a.slot', 'c.sample_id')})) = 1),
{t} AS (SELECT * FROM {t}_met UNION ALL SELECT * FROM {t}_near UNION ALL SELECT * FROM {t}_exact)"""
    cross = kind == "different_chirp_cross_detector"
    # The k-th valid candidate in order of ord: those apart from the anchor's own, numbered per anchor by what lies before them.
    on = " AND ".join(f"a.{k} <> c.{k}" if cross and k == "detector" else f"a.{k} = c.{k}" for k in keys)
    size_on = " AND ".join(f"a.{k} <> z.{k}" if cross and k == "detector" else f"a.{k} = z.{k}" for k in keys)
    own_on = " AND ".join(f"a.{k} <> o.{k}" if cross and k == "detector" else f"a.{k} = o.{k}" for k in keys)
    return f"""{pool}, {t}_size AS (SELECT {key}, count(*) AS n FROM {t}_pool GROUP BY {key}),
{t}_own AS (SELECT {key}, {apart} AS apart, min(idx) AS first_own, count(*) AS n_own FROM {t}_pool GROUP BY {key}, {apart}),
{t}_want AS (
  SELECT a.*, floor({u(kind, 'a.sample_id', 'a.slot')} * (z.n - coalesce(o.n_own, 0)))::BIGINT AS k, coalesce(o.first_own, z.n) AS first_own, coalesce(o.n_own, 0) AS n_own
  FROM {anchors} a JOIN {t}_size z ON {size_on} LEFT JOIN {t}_own o ON {own_on} AND a.{apart} = o.apart WHERE z.n > coalesce(o.n_own, 0)),
{t} AS (
  SELECT {_described(kind)} FROM {t}_want a JOIN {t}_pool c ON {on} AND c.idx = CASE WHEN a.k < a.first_own THEN a.k ELSE a.k + a.n_own END)"""


_OUT = """split, anchor_sample_id, candidate_sample_id, anchor_event_id, candidate_event_id, anchor_chirp_id, candidate_chirp_id,
  anchor_detector, candidate_detector, same_chirp, same_event, valid_time_delay, time_delay_difference, frequency_overlap_score,
  snr_bin_anchor, snr_bin_candidate, negative_type"""


def one_per_anchor(kind: str) -> str:
    return f"WITH {BASE}, anchors AS (SELECT *, 0 AS slot FROM chirps), {pick(kind, 'anchors', 'p')} SELECT {_OUT} FROM p"


def _list(names: tuple[str, ...]) -> str:
    parts = []
    for n in names:
        flag = {"chirp_vs_glitch": "g = 1", "chirp_vs_noise": "q = 1"}.get(n, "true")
        parts.append(f"CASE WHEN {flag} THEN '{n}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


SLOTS = f"""flags AS (
  SELECT split, max((global_class = 'glitch_only' OR (has_glitch = 1 AND has_chirp = 0))::INT) AS g, max((global_class = 'pure_noise')::INT) AS q
  FROM sample GROUP BY split),
tiers0 AS (SELECT split, {_list(HARD_TYPES)} AS hard, {_list(EASY_TYPES)} AS easy FROM flags),
tiers AS (
  SELECT split, CASE WHEN len(hard) > 0 THEN hard ELSE easy END AS hard, CASE WHEN len(easy) > 0 THEN easy ELSE hard END AS easy, list_concat(hard, easy) AS every
  FROM tiers0),
slotted AS (
  SELECT c.*, s.slot, CASE WHEN s.slot <= 2 THEN hard ELSE easy END AS names
  FROM chirps c JOIN tiers USING (split), (SELECT unnest([1, 2, 3]) AS slot) s),
slots AS (SELECT * EXCLUDE (names), names[floor({u('type', 'sample_id', 'slot')} * len(names))::BIGINT + 1] AS negative_type FROM slotted)"""


def _negatives() -> str:
    kinds = (*HARD_TYPES, *EASY_TYPES)
    parts = []
    for k, kind in enumerate(kinds):
        parts.append(f"anchors{k} AS (SELECT * EXCLUDE (negative_type) FROM slots WHERE negative_type = '{kind}')")
        parts.append(pick(kind, f"anchors{k}", f"p{k}"))
    union = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(len(kinds)))
    parts.append(f"filled AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY negative_type, anchor_sample_id, candidate_sample_id ORDER BY slot) = 1)")
    parts.append("lacking AS (SELECT split, unnest(every) AS negative_type FROM tiers EXCEPT SELECT split, negative_type FROM filled)")
    for k, kind in enumerate(kinds):
        parts.append(f"late{k} AS (SELECT c.*, 0 AS slot FROM chirps c SEMI JOIN (SELECT split FROM lacking WHERE negative_type = '{kind}') l ON c.split = l.split)")
        parts.append(pick(kind, f"late{k}", f"q{k}"))
    union = " UNION ALL ".join(f"(SELECT * FROM q{k} QUALIFY rank() OVER (PARTITION BY split ORDER BY a_ord) = 1)" for k in range(len(kinds)))
    parts.append(f"topped AS ({union}), every_negative AS (SELECT * FROM filled UNION ALL SELECT * FROM topped)")
    parts.append(f"""negatives AS (
  SELECT row_number() OVER (ORDER BY {_PLACE}, (slot = 0)::INT, a_ord, slot, negative_type) AS negative_pair_id, {_OUT} FROM every_negative)""")
    return ",\n".join(parts)


NEGATIVES = f"{SLOTS},\n{_negatives()}"

COMBINED = f"""combined AS (
  SELECT p.match_id AS pair_id, 1 AS pair_label, 'positive_same_chirp' AS pair_type, p.split, p.anchor_sample_id, p.positive_sample_id AS candidate_sample_id,
         p.event_id AS anchor_event_id, p.event_id AS candidate_event_id, p.chirp_id AS anchor_chirp_id, p.chirp_id AS candidate_chirp_id,
         p.anchor_detector, p.positive_detector AS candidate_detector, 1 AS same_chirp, 1 AS same_event,
         coalesce(abs(a.injection_time - c.injection_time) <= 0.012::DOUBLE, false)::INT AS valid_time_delay,
         round(abs(a.injection_time - c.injection_time), 6) AS time_delay_difference, round({iou('a.', 'c.')}, 6) AS frequency_overlap_score,
         a.snr_bin AS snr_bin_anchor, c.snr_bin AS snr_bin_candidate, 'positive_same_chirp' AS notes
  FROM positives p JOIN sample a ON p.anchor_sample_id = a.sample_id JOIN sample c ON p.positive_sample_id = c.sample_id
  UNION ALL
  SELECT negative_pair_id + (SELECT count(*) FROM positives), 0, negative_type, split, anchor_sample_id, candidate_sample_id, anchor_event_id, candidate_event_id,
         anchor_chirp_id, candidate_chirp_id, anchor_detector, candidate_detector, same_chirp, same_event, valid_time_delay, time_delay_difference,
         frequency_overlap_score, snr_bin_anchor, snr_bin_candidate, negative_type FROM negatives)"""
