"""The jobs as registered queries: each runs twice into one new folder, and the result is what then stands there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from chirplake.operators.scratch import scratch_root
from chirplake.plans.sql_views import POOL, digest_key
from jobs import grow_pool, split_documents


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job1_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, settings = _new_folder(spark, "job1"), json.loads(split_documents.CONFIG.read_text())
    run = lambda: split_documents.split_documents(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{out}/output", settings)
    run()
    return run()


def job2_grow_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, settings = _new_folder(spark, "job2"), json.loads(grow_pool.CONFIG.read_text())
    run = lambda: grow_pool.grow_pool(spark, f"{sf_dir}/events.parquet", f"{out}/output", f"{out}/checkpoint", settings)
    run()
    return run()


QUERIES = {f.__name__: f for f in (job1_split_documents, job2_grow_pool)}

#: The allocation of the groups in ``counts`` (ifo, grp, n).
_ASSIGNED = f"""
sized AS (SELECT *, md5({digest_key('group', 'grp')}) AS tie, sum(n) OVER (PARTITION BY ifo) AS total FROM counts),
heavy AS (SELECT *, row_number() OVER (PARTITION BY ifo ORDER BY n DESC, tie, grp) AS k FROM sized WHERE n >= total * 0.0625::DOUBLE),
fold AS (
  SELECT DISTINCT ifo, 0::BIGINT AS k, total * 0.70::DOUBLE AS a, total * 0.15::DOUBLE AS b, total * 0.15::DOUBLE AS c, NULL::VARCHAR AS grp, 0::BIGINT AS n, NULL::VARCHAR AS split FROM sized
  UNION ALL
  SELECT f.ifo, h.k, CASE WHEN s = 'train' THEN a - h.n ELSE a END, CASE WHEN s = 'val' THEN b - h.n ELSE b END, CASE WHEN s = 'test' THEN c - h.n ELSE c END, h.grp, h.n, s
  FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS s FROM fold) f JOIN heavy h ON h.ifo = f.ifo AND h.k = f.k + 1),
lacks AS (SELECT ifo, arg_max(greatest(a, 0), k) AS a, arg_max(greatest(b, 0), k) AS b, arg_max(greatest(c, 0), k) AS c FROM fold GROUP BY ifo),
light AS (
  SELECT s.ifo, grp, n, a, b, c,
         (coalesce(sum(n) OVER (PARTITION BY s.ifo ORDER BY tie, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) / sum(n) OVER (PARTITION BY s.ifo) AS spot
  FROM sized s JOIN lacks l ON s.ifo = l.ifo WHERE n < total * 0.0625::DOUBLE),
assigned AS (
  SELECT ifo, grp, split FROM fold WHERE k > 0
  UNION ALL SELECT ifo, grp, CASE WHEN spot * (a + b + c) < a THEN 'train' WHEN spot * (a + b + c) < a + b THEN 'val' ELSE 'test' END FROM light)"""

SQL = {
    "job1_split_documents": f"""WITH RECURSIVE
docs AS (SELECT doc_id, lang, source, text, coalesce('source:' || source, '') AS grp, sha256(text) AS digest FROM documents),
counts AS (SELECT 'all' AS ifo, grp, count(*) AS n FROM docs GROUP BY grp), {_ASSIGNED},
placed AS (SELECT d.*, a.split FROM docs d JOIN assigned a ON d.grp = a.grp),
homes AS (SELECT digest, first(split ORDER BY doc_id NULLS LAST, split) AS home FROM placed WHERE digest IS NOT NULL GROUP BY digest),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT p.doc_id, lang, source, quality, toxic, p.digest, text, split
FROM placed p LEFT JOIN homes h ON p.digest = h.digest LEFT JOIN known k ON p.doc_id = k.doc_id WHERE coalesce(home = split, true)""",
    "job2_grow_pool": f"""WITH RECURSIVE {POOL},
kept AS (SELECT * FROM gpool WHERE gps IS NOT NULL AND coalesce(snr >= 0, true) QUALIFY row_number() OVER (PARTITION BY ifo, gps ORDER BY ord) = 1),
counts AS (SELECT ifo, grp, count(*) AS n FROM kept GROUP BY ifo, grp), {_ASSIGNED}
SELECT ord, gps, label, snr, k.grp, 0::BIGINT AS batch, a.split, k.ifo FROM kept k JOIN assigned a ON k.ifo = a.ifo AND k.grp = a.grp""",
}
