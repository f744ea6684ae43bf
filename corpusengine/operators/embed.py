"""Model hooks.

``tfidf_embed`` is the built-in lexical embedder: a Spark ML pipeline
(RegexTokenizer -> HashingTF -> IDF -> Normalizer) giving unit-length
array<float> vectors of a fixed dimension. It is not a semantic model.

``model_embed`` and ``model_generate`` plug in any batch model through an
Arrow-batched pandas UDF: ``make_model()`` is called once per Python worker
(cached), and the returned callable maps a list of strings to a batch of
outputs. Spark partitions and schedules the work; the model only sees
batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODELS: dict[str, Callable] = {}


def _model(make_model: Callable) -> Callable:
    """The model of ``make_model``, built once per Python worker process
    (workers are reused across tasks, the factory is keyed by its pickle)."""
    import hashlib

    from pyspark import cloudpickle

    key = hashlib.sha1(cloudpickle.dumps(make_model)).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = make_model()
    return _MODELS[key]


TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def fit_tfidf(df: DataFrame, text_col: str, dim: int = 384, min_doc_freq: int = 0):
    """Fit the lexical embedder (IDF statistics are one distributed pass)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf", minDocFreq=min_doc_freq),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df)


def apply_tfidf(model, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
    """Embed ``df`` with a fitted model (same vocabulary hashing and IDF)."""
    from pyspark.ml.functions import vector_to_array

    inp = df if text_col == model.stages[0].getInputCol() else df.withColumnRenamed(
        text_col, model.stages[0].getInputCol())
    out = model.transform(inp).withColumn(out_col, vector_to_array("_vec", "float32"))
    return out.drop("_tok", "_tf", "_idf", "_vec")


def tfidf_embed(df: DataFrame, text_col: str, dim: int = 384, out_col: str = "embedding",
                min_doc_freq: int = 0) -> DataFrame:
    """Fit on ``df`` and embed it."""
    return apply_tfidf(fit_tfidf(df, text_col, dim, min_doc_freq), df, text_col, out_col)


def hashing_embed(df: DataFrame, text_col: str, dim: int = 384, out_col: str = "embedding") -> DataFrame:
    """Stateless lexical embedder (no fitted IDF), so vectors of different
    daily batches stay comparable."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, toLowercase=True).transform(df)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(tok)
    norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0).transform(tf)
    return norm.withColumn(out_col, vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_vec")


def hash_counts(dim: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Factory for ``model_embed``: token counts in ``dim`` buckets (the first
    eight hex digits of a token's md5, modulo dim). Stateless and exactly
    repeatable in SQL; tokens are runs of ASCII letters and digits, lower-cased."""
    import hashlib
    import re

    def make():
        token = re.compile(r"[a-z0-9]+")
        buckets: dict[str, int] = {}

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for t in token.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)):
                    b = buckets.get(t)
                    if b is None:
                        if len(buckets) > 200_000:
                            buckets.clear()
                        b = buckets[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                    out[i, b] += 1
            return out

        return embed

    return make


def model_embed(text: Column, make_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """array<float> per text from a user model."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        model = _model(make_model)
        vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
        return pd.Series(list(vecs))

    return _embed(text)


def model_generate(prompt: Column, make_model: Callable[[], Callable[[list[str]], list[str]]]) -> Column:
    """Generated text per prompt from a user model (X2); use as
    ``answer_frame(generate=lambda p: model_generate(p, make_model))``."""

    @F.pandas_udf(T.StringType())
    def _gen(prompts: pd.Series) -> pd.Series:
        model = _model(make_model)
        mask = prompts.notna()
        out = pd.Series([None] * len(prompts), dtype=object)
        if mask.any():
            out[mask] = model(prompts[mask].tolist())
        return out

    return _gen(prompt)
