"""Chunks with lines of their neighbours, and methods of class chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import lines
from loomdex.operators.chunking.ast_chunks import METHODS, parse
from loomdex.operators.tenants import file_key, owner
from loomdex.runtime import ship

#: What stands between a chunk's text and the lines of its neighbours.
SEPARATOR = "\n\n// ---\n\n"


def with_neighbours(chunks: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """``chunks`` with ``overlap_text``: the last n lines up to the previous chunk's end, the text, n lines from the next one's start.

    Chunks of a file are in order of line_start; those at its ends have one neighbour.
    """
    key = file_key(chunks)
    line = Window.partitionBy(*key).orderBy("line_start", "line_end")
    placed = chunks.withColumns({"__before": F.lag("line_end").over(line), "__after": F.lead("line_start").over(line)})
    rest = [c for c in placed.columns if c not in key]
    # A file meets its chunks as one list: its lines aren't copied to each of them.
    listed = placed.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("__c"))
    met = listed.join(files.select(*key, lines(F.col("content")).alias("__l")), key)

    def overlapping(c):
        first = F.greatest(c["__before"] - n, F.lit(0))
        prefix = F.array_join(F.slice("__l", first + 1, c["__before"] - first), "\n")
        suffix = F.array_join(F.slice("__l", c["__after"], F.lit(n)), "\n")
        parts = F.filter(F.array(prefix, c["text"], suffix), lambda p: p.isNotNull() & (p != ""))
        return F.struct(*[c[x].alias(x) for x in rest if not x.startswith("__")], F.array_join(parts, SEPARATOR).alias("overlap_text"))

    return met.select(*key, F.explode(F.transform("__c", overlapping)).alias("c")).select(*key, "c.*").select(*chunks.columns, "overlap_text")


def methods_of_classes(chunks: DataFrame) -> DataFrame:
    """``(..., relative_path, type, name, parent, line_start, line_end, text)`` of the methods within chunks of type class.

    A class chunk's text is parsed by itself in its ``language_id``; methods at any depth count, others languages' classes have none.
    """
    key, spark = owner(chunks), chunks.sparkSession
    ship(spark)
    columns = [*key, "relative_path", "type", "name", "parent", "line_start", "line_end", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                todo = list(parse(row["text"], row["language_id"]) or [])
                while todo:
                    node = todo.pop(0)
                    todo = node.children + todo
                    if (row["language_id"], node.kind) in METHODS:
                        first = row["line_start"] + row["text"].count("\n", 0, node.start)
                        body = row["text"][node.start : node.end]
                        own = {k: row[k] for k in (*key, "relative_path")}
                        out.append({**own, "type": "method", "name": node.name, "parent": row["name"], "line_start": first, "line_end": first + body.count("\n"), "text": body})
            yield pd.DataFrame(out, columns=columns)

    schema = ", ".join(f"{c} {'int' if c.startswith('line') else 'string'}" for c in columns)
    classes = chunks.where("type = 'class' and text is not null").select(*key, "relative_path", "language_id", "name", "line_start", "text")
    return classes.mapInPandas(run, schema)
