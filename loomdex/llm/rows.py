"""Taking the rows of a table that a decision keeps, without a unique row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def text_key(text: str = "text") -> Column:
    """A hash of a text; null as one of its own."""
    return F.xxhash64(F.col(text))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns but maps: together with doc_id this tells rows apart, and rows equal in both are interchangeable."""
    return F.xxhash64(*[docs[f.name] for f in docs.schema if not isinstance(f.dataType, MapType)])


def first_of(doc_id: Column, key: Column) -> Column:
    """What the row that stays is the least in: doc_id, nulls last, then the row's key, so that reruns agree."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), key.alias("key"))


def keep_chosen(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decided(doc_id, key, keep)`` keeps, one of those that are equal in everything.

    ``decided`` has a row for each row of ``docs``, key being :func:`row_key`. Columns of ``docs`` stay as they are,
    whatever their names. Decisions are joined once with whole rows.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs["doc_id"].alias("d"), row_key(docs).alias("k"))
    told = decided.groupBy(F.col("doc_id").alias("td"), F.col("key").alias("tk")).agg(F.bool_or("keep").alias("keep"), F.count("*").alias("n"))
    marked = told.where("not keep or n > 1")
    met = keyed.join(marked, keyed["d"].eqNullSafe(marked["td"]) & (keyed["k"] == marked["tk"]), "left")
    once = met.where("keep is null").select("r.*")
    if told.where("keep and n > 1").isEmpty():
        return once
    return once.unionByName(met.where("keep").dropDuplicates(["d", "k"]).select("r.*"))
