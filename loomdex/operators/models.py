"""Summaries and embeddings by pluggable providers, with deterministic ones that need no network."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.config import EngineConfig
from loomdex.functions.requests import NO_INPUT, NO_LANGUAGE, NO_TEXTS
from loomdex.functions.text import NO_SUMMARY, parse_summaries_standalone, token_usage
from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import ship

#: Code of one language to summaries, in order; may raise.
Summarizer = Callable[[list[str], str], list[str]]
#: Texts to vectors, in order; may raise.
Embedder = Callable[[list[str]], list[list[float]]]


def template_summarizer(codes: list[str], language: str) -> list[str]:
    """The whole code as one line: each run of white space is one space."""
    out = []
    for code in codes:
        line = re.sub(r"[ \t\n\x0b\f\r]+", " ", code).strip(" ")
        out.append(f"{language} code: {line}" if line else NO_SUMMARY)
    return out


def hashing_embedder(dimensions: int) -> Embedder:
    """Signed feature hashing of lower-cased words, of length 1; the zero vector for no words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions), np.float64)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                row[h % dimensions] += 1.0 if h >> 31 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0).astype(np.float32).tolist()

    return embed


def with_timeout(provider: Callable, seconds: float) -> Callable:
    """The provider, whose calls raise TimeoutError if they take longer: a failure like others."""

    def call(*args):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(provider, *args).result(timeout=seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return call


def summaries(chunks: DataFrame, provider: Summarizer = template_summarizer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(hash, summary)`` of the distinct hashes of ``chunks(hash, language_id, code, ...)``.

    Batches are of one language; a batch that fails or returns another number of summaries gets the default one.
    """
    size, provider = config.summary_batch, with_timeout(provider, config.model_timeout)
    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            hashes, summaries = [], []
            for language, group in rows.groupby("language_id", sort=False, dropna=False):
                for at in range(0, len(group), size):
                    part = group.iloc[at : at + size]
                    try:
                        found = list(provider(part["code"].tolist(), language))
                    except Exception:  # a provider's failure is an answer here, not an error
                        found = []
                    if len(found) != len(part):
                        found = [NO_SUMMARY] * len(part)
                    hashes += part["hash"].tolist()
                    summaries += found
            yield pd.DataFrame({"hash": hashes, "summary": summaries}, dtype=object)

    # Of chunks of one hash the last one speaks for all.
    order = [c for c in ("seq", "language_id", "code") if c in chunks.columns]
    distinct = latest_by_key(chunks.select("hash", *{"language_id": 0, "code": 0, **dict.fromkeys(order)}), ["hash"], order).select("hash", "language_id", "code")
    return distinct.mapInPandas(run, "hash string, summary string")


def summarize(chunks: DataFrame, provider: Summarizer = template_summarizer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``chunks(hash, language_id, code, ...)`` with ``summary``; distinct code is summarized once, as by :func:`summaries`."""
    return chunks.join(summaries(chunks, provider, config), "hash")


def embed(rows: DataFrame, text: str, provider: Embedder | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``rows`` with ``embedding`` of a text column; a batch that fails is of zero vectors, short ones are padded with them."""
    run_batch, size, width = with_timeout(provider or hashing_embedder(config.dimensions), config.model_timeout), config.embedding_batch, config.dimensions
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        values, out = texts.fillna("").tolist(), []
        for at in range(0, len(values), size):
            part = values[at : at + size]
            try:
                found = [list(v) for v in run_batch(part)]
            except Exception:  # as above
                found = []
            out += (found + [[0.0] * width] * len(part))[: len(part)]
        return pd.Series(out)

    return rows.withColumn("embedding", vectors(F.col(text)))


def embed_query(text: str, provider: Embedder, dimensions: int, attempts: int = 2, config: EngineConfig = EngineConfig()) -> list[float]:
    """The vector of a query, tried twice with a pause between; the zero vector if that fails or takes too long."""
    timed = with_timeout(provider, config.query_timeout)
    for attempt in range(attempts):
        if attempt:
            time.sleep(config.retry_pause)
        try:
            return list(timed([text])[0])
        except Exception:  # as above
            continue
    return [0.0] * dimensions


#: A prompt and the number of summaries to a response, or None; may raise.
Completer = Callable[[str, int], str | None]


def _prompt(codes: list[str], language: str) -> str:
    numbered = "\n".join(f"[CHUNK {i + 1}]\n{code}\n" for i, code in enumerate(codes))
    return f"Describe each of these {len(codes)} pieces of {language} code in one line: [N] text, numbered from 1.\n\n{numbered}"


def summarize_requests(requests: DataFrame, complete: Completer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(request_id, status, summaries, timed_out, error)`` of ``requests(request_id, texts array<string>, language_id)``.

    status is 400 with the reason where texts or language_id are missing; else 200, whatever the model does: the default
    summaries stand for a call that failed or took too long, and for an empty response.
    """
    call = with_timeout(complete, config.model_timeout)
    ship(requests.sparkSession)

    def answer(texts, language):
        if texts is None or not language:
            return 400, None, False, NO_TEXTS if texts is None else NO_LANGUAGE
        n = len(texts)
        try:
            return 200, parse_summaries_standalone(call(_prompt(list(texts), language), n), n), False, None
        except TimeoutError:
            return 200, [NO_SUMMARY] * n, True, None
        except Exception as e:  # as above
            return 200, [NO_SUMMARY] * n, False, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = [answer(t, l) for t, l in zip(rows["texts"], rows["language_id"], strict=True)]
            yield pd.concat([rows[["request_id"]].reset_index(drop=True), pd.DataFrame(told, columns=["status", "summaries", "timed_out", "error"])], axis=1)

    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, status int, summaries array<string>, timed_out boolean, error string"
    return requests.select("request_id", "texts", "language_id").mapInPandas(run, schema)


def embedding_requests(requests: DataFrame, provider: Embedder | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(request_id, status, data array<struct<index, embedding>>, prompt_tokens, total_tokens, timed_out, error)`` of ``requests(request_id, input array<string>)``.

    status is 400 where the input is missing; vectors that the provider doesn't give are zero. Tokens are what
    white space cuts the joined input into.
    """
    width, call = config.dimensions, with_timeout(provider or hashing_embedder(config.dimensions), config.model_timeout)
    ship(requests.sparkSession)

    def answer(texts):
        if texts is None or len(texts) == 0:
            return 400, None, False, NO_INPUT
        late, error, found = False, None, []
        try:
            found = [list(map(float, v)) for v in call(list(texts))]
        except TimeoutError:
            late = True
        except Exception as e:  # as above
            error = str(e)
        found = (found + [[0.0] * width] * len(texts))[: len(texts)]
        return 200, [{"index": i, "embedding": v} for i, v in enumerate(found)], late, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = pd.DataFrame([answer(t) for t in rows["input"]], columns=["status", "data", "timed_out", "error"])
            yield pd.concat([rows[["request_id"]].reset_index(drop=True), told], axis=1)

    kind = requests.schema["request_id"].dataType.simpleString()
    schema = f"request_id {kind}, status int, data array<struct<index:int,embedding:array<float>>>, timed_out boolean, error string"
    told = requests.select("request_id", "input").mapInPandas(run, schema)
    tokens = requests.select("request_id", token_usage(F.col("input")).cast("long").alias("prompt_tokens"))
    met = told.join(tokens.withColumn("total_tokens", F.col("prompt_tokens")), "request_id")
    usage = [F.when(F.col("status") == 200, F.col(c)).alias(c) for c in ("prompt_tokens", "total_tokens")]
    return met.select("request_id", "status", "data", *usage, "timed_out", "error")
