"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks where its own content says so, each chunk gets a
short identifier, and texts are equal when their ordered lists of identifiers
(recipes) are. Texts are read and cut once; what moves afterwards is a 64-bit
identifier and a 256-bit digest for each chunk of about a thousand characters.

Identifiers are verified: an identifier that stands for two different digests
anywhere in the table gets an ordinal for each, which then takes part in the
comparison. Groups of any size are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.rows import first_of, keep_chosen, row_key
from loomdex.runtime import materialize

WHITESPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends after a space that follows one of these characters, at 1,024 to 8,192
#: characters; without such a place, after 8,192.
CHUNK = r"(?s).{1023,8191}?(?<=[dgkmpy.,;:!?] )|.{1,8192}"


def normalized(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def _recipes(docs: DataFrame, identifier=F.xxhash64) -> DataFrame:
    """(doc_id, key, tie, text_sha256, ids, ordinals) of each row; ordinals only where identifiers clash."""
    text = normalized(docs["text"])
    cut = docs.select(
        docs["doc_id"].alias("doc_id"),
        row_key(docs).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
        text.alias("t"),
    ).select(
        "doc_id",
        "key",
        "tie",
        F.sha2("t", 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)),
            lambda c: F.struct(identifier(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("chunks"),
    )
    cut = materialize(cut, "recipes")
    known = cut.select(F.explode("chunks").alias("c")).select("c.id", "c.digest").distinct()
    clashing = materialize(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "clashing")
    listed = cut.withColumn("ids", F.col("chunks.id"))
    places = "array<struct<pos:int,ordinal:int>>"
    if clashing.isEmpty():
        return listed.withColumn("ordinals", F.lit(None).cast(places)).drop("chunks")
    # The ordinal of a digest is the number of smaller digests with its identifier.
    those = known.join(clashing, "id")
    ordinal = (
        those.join(those.withColumnRenamed("digest", "other"), "id")
        .groupBy("id", "digest")
        .agg(F.count_if(F.col("other") < F.col("digest")).cast("int").alias("ordinal"))
    )
    spread = cut.select("tie", F.posexplode("chunks").alias("pos", "c")).select("tie", "pos", "c.id", "c.digest")
    met = spread.join(ordinal, ["id", "digest"]).groupBy("tie")
    ordinals = met.agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).cast(places).alias("ordinals"))
    return listed.join(ordinals, "tie", "left").drop("chunks")


def duplicate_groups(docs: DataFrame, identifier=F.xxhash64) -> DataFrame:
    """``(doc_id, key, grp, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs(doc_id, text)``.

    Texts are equal when identical after each run of white space is made one space;
    null counts as empty. keep_id is the group's least doc_id (null if it has none),
    kept is true on one row of the group, which has that doc_id, even if rows repeat
    it: then on that of the least hash of all columns. ``grp`` is equal in rows of one group. An empty table gives no rows.
    """
    rows = materialize(_recipes(docs, identifier).withColumn("grp", F.struct("ids", "ordinals")).drop("ids", "ordinals"), "rows")
    first = F.min(F.struct(first_of(F.col("doc_id"), F.col("key")).alias("row"), F.col("tie").alias("t")))
    groups = rows.groupBy("grp").agg(first.alias("first"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("grp").alias("g"), F.col("first.row.doc_id").alias("keep_id"), "first.t", "group_size")
    same = (rows["grp"]["ids"] == groups["g"]["ids"]) & rows["grp"]["ordinals"].eqNullSafe(groups["g"]["ordinals"])
    return rows.join(groups, same).select(
        "doc_id", "key", "grp", "keep_id", "group_size", (F.col("tie") == F.col("t")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the least doc_id; columns as they are."""
    return keep_chosen(docs, materialize(duplicate_groups(docs).select("doc_id", "key", F.col("kept").alias("keep")), "groups"))
