"""Exact duplicates in three combining steps, all of them DataFrame operations.

1. Each task drops the copies it holds itself: the partial aggregate of step 2.
2. The remaining rows of a digest meet in ``salts`` groups, where a row's salt comes from
   the partition it was read in. A text that a third of all rows hold gives at most one
   row per input partition, spread over the salts.
3. The winners of the salts are combined once more over all salts.

Steps 1 to 3 group by digest *and* text, so rows are merged only when their whole texts are
equal. Documents then look their winner up by digest; two texts with one digest (never seen,
but not assumed away) are told apart by their text there too.

Null text counts as empty. Null ids are kept, and a null id wins only where no row of the
group has an id. Repeated rows (same id and text) stay as many rows as they are, all with the
same answer. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import keep_rows
from strandweave.plans.settle import settle, table

_OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text"), 256))
    )


def text_groups(docs: DataFrame, salts: int = 32) -> DataFrame:
    """``(digest, text, keep_id, group_size)``, one row per different text."""
    local = _digested(docs).withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "text", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_duplicates(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays. An empty table gives no rows.
    """
    # the texts are shuffled once; what is written names them by digest
    groups = table(text_groups(docs, salts).select("digest", "keep_id", "group_size"), "texts")
    copied = groups.filter("group_size > 1")
    # a digest with two texts would have two rows among all groups
    doubled, seen = settle(
        groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"),
        "doubled",
    )
    rows = _digested(docs)
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    named = rows.select("doc_id", "digest", salt.alias("salt"))
    winners = copied.withColumn("salt", spread)
    if not seen["rows"]:
        found = named.join(winners, ["digest", "salt"], "left")
    else:
        plain = named.join(doubled, "digest", "left_anti").join(
            winners.join(doubled, "digest", "left_anti"), ["digest", "salt"], "left"
        )
        clashing = rows.join(doubled, "digest", "left_semi")
        exact = clashing.join(
            text_groups(docs, salts).join(doubled, "digest", "left_semi"), ["digest", "text"]
        )
        found = plain.drop("salt").unionByName(
            exact.select("doc_id", "digest", "keep_id", "group_size")
        )
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ).select(*_OUT)


def drop_exact_duplicates(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row of each text of ``docs``, with all its columns: that of the largest id, of rows equal in id and
    text any one. A row with a null id stays only where no row of its text has an id."""
    found = exact_duplicates(docs.select("doc_id", "text"), salts)
    named = found.select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return keep_rows(docs, named, "copies", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
