"""Release documents as train, val and test sets that share neither a source nor a text.

    python -m jobs.split_documents --documents PATH --labels PATH --output PATH [--config FILE]

Whole sources go to one split, so that none is learnt from and tested on. A text that
sources of several splits hold stays in the split of its first holder, the smallest
doc_id, and is held back elsewhere. The output has two folders: ``documents``, with the
labels joined on, partitioned by status (released or held_back) and split; and
``manifest``, a JSON line a split, which is written last, once the audits of the written
rows have found nothing. A run overwrites the output of an earlier one; the same input
gives the same output.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.operators import audits, groups
from chirplake.operators.scratch import saved

log = logging.getLogger("jobs.split_documents")
CONFIG = Path(__file__).with_name("split_documents.json")


def assigned_sources(docs: DataFrame, settings: dict) -> DataFrame:
    """grp, split of every source; a null source is one of its own."""
    counts = docs.groupBy("grp").agg(F.count("*").alias("n")).withColumn("ifo", F.lit("all"))
    return groups.assign_many(counts, settings["ratios"], heavy=settings["heavy"]).select("grp", "split")


def marked_copies(docs: DataFrame) -> DataFrame:
    """Add ``home``: the split of the first holder of a text that several splits hold, null for all other texts.

    Null texts are no copies of each other. The first holder is the smallest doc_id, and
    null comes last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "split"))
    texts = docs.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.min("split").alias("low"), F.max("split").alias("high"))
    shared = texts.where("low <> high").select("digest", F.col("first.split").alias("home"))
    return docs.join(shared, "digest", "left")


def split_documents(spark: SparkSession, documents: str, labels: str, output: str, settings: dict) -> DataFrame:
    """Run the job; the released documents as they were written.

    A document without a label has nulls for it, and of several labels of a doc_id the
    largest counts. Rows that repeat a doc_id are documents of their own. Empty input
    gives empty output. Other columns of ``documents`` are not released.
    """
    docs = spark.read.parquet(documents)
    known = spark.read.parquet(labels).where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    log.info("read %d documents from %s and %d labelled doc_ids from %s", docs.count(), documents, known.count(), labels)
    grp = F.coalesce(F.concat(F.lit("source:"), F.col("source")), F.lit(""))
    keyed = docs.select("doc_id", "lang", "source", "text", grp.alias("grp"), F.sha2("text", 256).alias("digest"))
    assignment = saved(assigned_sources(keyed, settings), "sources")
    placed = keyed.join(assignment, "grp")
    status = F.when(F.coalesce(F.col("home") == F.col("split"), F.lit(True)), "released").otherwise("held_back")
    marked = marked_copies(placed).join(known, "doc_id", "left").withColumn("status", status)
    rows = marked.select("doc_id", "lang", "source", "quality", "toxic", "digest", "text", "status", "split")
    rows.write.mode("overwrite").partitionBy("status", "split").parquet(f"{output}/documents")
    written = spark.read.schema(rows.schema).parquet(f"{output}/documents")
    released, held = (written.where(F.col("status") == s).drop("status") for s in ("released", "held_back"))

    for what, key in (("source", grp), ("text", F.col("digest"))):
        if not (found := audits.leaks(released, key)).isEmpty():
            raise audits.AuditError(f"{what} in several splits: {audits.offenders(found)}")
    by_split = released.groupBy("split").agg(
        F.count("*").alias("documents"), F.count_distinct(grp).alias("sources"), F.count("quality").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"),
    ).join(held.groupBy("split").agg(F.count("*").alias("held_back")), "split", "left").fillna(0, ["held_back"])
    by_split.coalesce(1).write.mode("overwrite").json(f"{output}/manifest")
    for r in by_split.orderBy("split").collect():  # a row a split
        log.info("wrote %s: %d documents of %d sources, %d labelled, %d held back", r["split"], r["documents"], r["sources"], r["labelled"], r["held_back"])
    return released


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    given = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    settings = json.loads(Path(given.config).read_text())
    spark = SparkSession.builder.appName("split_documents").getOrCreate()
    try:
        split_documents(spark, given.documents, given.labels, given.output, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
