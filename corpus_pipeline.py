"""A corpus from documents to packed sequences, in stages that read and write tables.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but
the last return the columns of ``documents``.

- toxicity: documents that the classifier calls toxic go. It learns from the labelled rows that
  are still there and not held out.
- ngram_jaccard: of each group of linked documents the one with the least id stays, a null id
  being the greatest; of several with that id the one whose row has the least hash.
- pii: spans are replaced by their kind, ``n_chars`` follows.
- mixing: each document is repeated as often as its source's target asks, from never to three
  times; the copies keep the id.
- packing: one row per piece with its place in a sequence.

Nulls and repeated rows: documents are told apart by row, not by id. Documents with a null id, or
with an id that others have too, pass all stages like any other. Equal texts are linked, so a
repeated row goes with ngram_jaccard, unless its text is null or has no words: those are linked to
none and all stay. A null text stays null and has no words; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repoaudit.llm import jaccard, mixing, packing, pii, toxicity
from repoaudit.session import freeze

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.add_score(docs, model).where(F.col("score") < toxicity.TOXIC).select(*COLUMNS)


def remove_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = freeze(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found = jaccard.link(rows, key="_row").select(F.col("_row").alias("_at"), "component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "_row").alias("_order")
    ranked = rows.select("_row", order).join(found, F.col("_row") == F.col("_at"))
    kept = ranked.groupBy("component").agg(F.min("_order").alias("_least")).select(F.col("_least._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def mask_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(pii.find_pii(docs, output="_pii"), spans="_pii")
    changed = F.when(F.size("_pii") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*COLUMNS)


def repeat_by_source(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = freeze(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    copies = mixing.mix(rows, keep="_row").where("copies > 0").select(F.col("_row").alias("_at"), "copies")
    repeated = rows.join(copies, F.col("_row") == F.col("_at"))
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_digest(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", remove_near_copies),
    ("pii", mask_personal_data),
    ("mixing", repeat_by_source),
    ("packing", pack),
]
#: Training, components and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in their order over ``documents``; what a stage returns is kept for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
