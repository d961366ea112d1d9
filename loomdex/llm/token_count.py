"""Token counts by count-only Viterbi: a score and a number of pieces for each character, no paths."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.unigram import segmenter

#: Folder of public tokenizers' files, and the model used.
TOKENIZERS = os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"


def read_model(path: str | None = None) -> bytes:
    """The model file, read by the driver; executors get its bytes."""
    with open(path or f"{TOKENIZERS}/{MODEL}", "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``, a row for each row of ``docs(doc_id, text)``.

    The number of pieces of the best unigram segmentation of the whole text; 0 for empty
    or null text. An empty table gives no rows; repeated rows are counted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = segmenter(shared.value).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return docs.select("doc_id", tokens(docs["text"]).alias("n_tokens"))
