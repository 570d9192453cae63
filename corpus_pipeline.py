"""The corpus pipeline: five stages, each applying one operator to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.llm.common import bound_batches, bounded_broadcast, fresh_name, store, table

#: Ids of removed near-duplicates that may be broadcast; beyond, a shuffled join removes them.
REMOVED_BROADCAST = 500_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the lexicon, learned from the labelled ones among them, calls toxic.

    Null and empty texts stay, repeated rows share their fate, an empty table stays empty."""
    from starling.llm.toxicity import learn, score_udf

    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_udf(lexicon)(F.col("text"))["predicted"] == 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more.

    Documents without words all stay, but for repeats of a row's id and text; rows
    without id all stay and link nothing. Where ids are repeated, rows are told apart
    by id and text, so that none goes because of another of its id."""
    from starling.llm.near_dedup import near_duplicates

    id_of, mark, nth = "doc_id", fresh_name(docs, "row_id"), fresh_name(docs, "nth")
    unique = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if not unique:
        of_row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())
        docs, id_of = docs.withColumn(mark, F.when(F.col("doc_id").isNotNull(), of_row)), mark
    found = store(near_duplicates(docs, k=5, num=80, den=100, id_col=id_of), "pipeline-groups")
    removed = found.where("not kept").select(F.col("doc_id").alias(id_of)).distinct()
    kept = docs.join(bounded_broadcast(removed, REMOVED_BROADCAST), id_of, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    if not unique:  # one of the rows that repeat both
        first = F.row_number().over(Window.partitionBy(mark).orderBy("source", "lang"))
        kept = kept.where(F.col(mark).isNotNull()).withColumn(nth, first).where(F.col(nth) == 1).drop(nth).union(kept.where(F.col(mark).isNull())).drop(mark)
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, in whatever order its passages stand.

    Null, empty and wordless texts stay, as does everything if there is no benchmark."""
    from starling.llm.decontaminate import drop_leaks

    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that look live, that is, which few owners carry; all documents stay.

    A null text stays null; a null source counts as one owner. n_chars follows the masked text."""
    from starling.llm.secret_scan import redact_live

    masked = redact_live(docs)
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return masked.withColumn("n_chars", n_chars) if "n_chars" in masked.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: the documents' columns without the text, token_ids, n_tokens and whether the round trip is exact.

    A null text has no tokens. Columns of docs with these three names give way to them."""
    import public_tokenizers

    from starling.llm.bpe import encode_udf

    bound_batches(spark)
    encoded = encode_udf(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)(F.coalesce("text", F.lit("")))
    rows = docs.select(*[F.col(c) for c in docs.columns if c != "text"], encoded.alias(mark := fresh_name(docs, "encoded")))
    token = F.col(f"`{mark}`")
    return rows.withColumns({"token_ids": token["ids"], "n_tokens": F.size(token["ids"]).cast("long"), "exact": token["exact"]}).drop(mark)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]

#: No stage can be put into SQL as a whole; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
