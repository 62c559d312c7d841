"""Pluggable models: embedder, reranker, generator, summariser.

Each takes a plain Python function over lists of strings, run on Arrow batches;
``load`` is called once a worker task, so a model is loaded once and not once a
row. The built-in functions are deterministic stand-ins, not neural models.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from . import chunk as C

_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def hashing_embedder(dim: int = 64) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Loader of a feature-hashing embedder: unit vectors of signed term counts."""

    def load():
        def embed(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in _TOKEN.findall((t or "").lower()):
                    h = hashlib.md5(w.encode()).digest()
                    v[int.from_bytes(h[:2], "big") % dim] += 1 if h[2] % 32 < 16 else -1
                out.append(v / (np.linalg.norm(v) + 1e-8))
            return out

        return embed

    return load


def embed(text: Column, load=None, prompt: str = "") -> Column:
    """A vector for each text; a query and a document may have different prompts before them."""
    load = load or hashing_embedder()

    @F.pandas_udf(K.ArrayType(K.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series([v.tolist() for v in model([prompt + (t or "") for t in b])])

    return run(text)


def score(query: Column, text: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """A reranker's score of each (query, text); a batch that fails gives nulls, which the reranking reads as a fallback."""

    @F.pandas_udf(K.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            try:
                yield pd.Series(model(list(zip(q, t))), dtype="float64")
            except Exception:
                yield pd.Series([None] * len(q), dtype="float64")

    return run(query, text)


def score_yes_no(query: Column, text: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[tuple[float, float]]]]) -> Column:
    """A reranker that answers yes or no: the model gives two logits for each pair, the score is the probability of yes; a batch that fails gives nulls."""

    def one():
        model = load()

        def run(pairs):
            return [1 / (1 + np.exp(min(700.0, no - yes))) for yes, no in model(pairs)]

        return run

    return score(query, text, one)


def plain_pages(path: str, content: bytes) -> list[str]:
    """The default parser: text whose pages end with form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def parse_pages(files: DataFrame, load: Callable[[], Callable[[str, bytes], list[str]]] = lambda: plain_pages) -> DataFrame:
    """files(path, content) -> (path, page, text, error): a parser of whole files, loaded once a task; a file that it fails on gives one row with the error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = load()
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                try:
                    rows = [(path, n, t, None) for n, t in enumerate(parse(path, b.column(1)[i].as_py() or b""))]
                except Exception as e:
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "page", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def extractive(query: str, context: str, sentences: int, temperature: float) -> str:
    """The context's sentences that share most words with the query, in their order; a higher temperature lets in lower-ranked ones."""
    q = set(_TOKEN.findall(query.lower()))
    parts = [s.strip() for s in _SENTENCE.split(context) if s.strip()]
    ranked = sorted(range(len(parts)), key=lambda i: (-len(q & set(_TOKEN.findall(parts[i].lower()))), i))
    skip = int(temperature * sentences)
    return " ".join(parts[i] for i in sorted(ranked[skip : skip + sentences] or ranked[:sentences]))


def generate(rows: DataFrame, temperatures: tuple[float, ...] = (0.0,), sentences: int = 3, load=None) -> DataFrame:
    """rows(query_id, query, context) -> (query_id, temperature, answer), one answer for each temperature; the temperatures are a fixed list, exploded in the row."""
    load = load or (lambda: extractive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            out = [model(q or "", c or "", sentences, t) for q, c, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.string())], names=["query_id", "temperature", "answer"])

    temps = F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature")
    kind = dict(rows.dtypes)["query_id"]
    return rows.select("query_id", "query", "context", temps).mapInArrow(run, f"query_id {kind}, temperature double, answer string")


def lead(text: Column, n: int = 2) -> Column:
    """The default summary of a chunk: its first sentences."""
    return F.array_join(F.slice(T.sentences(F.trim(text)), 1, n), " ")


def summarise(docs: DataFrame, key: str, text: str, budget: int = 12_884, size: int = 8000, overlap: int = 200, depth: int = 3, summary: Callable[[Column], Column] = lead) -> DataFrame:
    """(key, summary, rounds): a text within the token budget is summarised at once; a longer one is cut by headers, its chunks summarised and joined, and so on up to ``depth`` times, then cut to the budget.

    Each round is one DataFrame pass over the texts that are still too long; the
    number of rounds is fixed, so the plan is bounded.
    """
    now = docs.select(key, F.col(text).alias("t"), F.lit(0).alias("rounds"))
    out = None
    for d in range(depth):
        fits = T.token_estimate(F.col("t")) <= budget
        done = now.where(fits).select(key, summary(F.col("t")).alias("summary"), "rounds")
        out = done if out is None else out.unionByName(done)
        pieces = C.by_headers(now.where(~fits), "t", size if d == 0 else min(size, 8000), overlap, [key, "rounds"])
        short = pieces.select(key, "rounds", "chunk_index", summary(F.col("chunk")).alias("s"))
        # The chunks of one text meet again: as many as that text's own size allows.
        joined = short.groupBy(key, "rounds").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "s"))).alias("parts"))
        now = joined.select(key, F.array_join(F.transform("parts", lambda p: F.concat(F.lit("Section "), (p["chunk_index"] + 1).cast("string"), F.lit(":\n"), p["s"])), "\n\n").alias("t"), (F.col("rounds") + 1).alias("rounds"))
    last = T.by_token_ratio(F.col("t"), F.greatest(F.lit(1).cast("long"), T.token_estimate(F.col("t"))), budget)
    return out.unionByName(now.select(key, summary(last).alias("summary"), "rounds"))
