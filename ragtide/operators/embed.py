"""Attach an embedding column to a text column.

The column contract is ``array<float>`` of a fixed dimension.  The default
encoder is a lexical stand-in built from JVM-side ML transformers
(tokenise -> feature hashing -> L2 normalise), because no sentence encoder is
installed.  Its scores are lexical, not semantic.  A real encoder plugs in as
any callable ``(DataFrame, text_col, out_col) -> DataFrame``, for instance
``pandas_encoder(fn)`` which runs a batch function in Arrow batches with the
model loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EMBEDDING_DIM = 384
# ----------------------------------------------------------------------------

# Unicode-aware split so accented words stay whole.
TOKEN_PATTERN = r"(?U)\W+"

Encoder = Callable[[DataFrame, str, str], DataFrame]


def hashed_encoder(dim: int = EMBEDDING_DIM) -> Encoder:
    def encode(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN,
                             toLowercase=True, minTokenLength=1)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        nrm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
        out = nrm.transform(tf.transform(tok.transform(df)))
        return (out.withColumn(out_col, vector_to_array("_nv", "float32"))
                .drop("_tok", "_tf", "_nv"))
    return encode


def pandas_encoder(batch_fn: Callable[[list[str]], list[list[float]]], dim: int = EMBEDDING_DIM) -> Encoder:
    """Wrap a batch encoding function (texts -> vectors) as a pandas UDF."""

    @F.pandas_udf("array<float>")
    def _enc(texts: pd.Series) -> pd.Series:
        return pd.Series(list(batch_fn(texts.fillna("").tolist())))

    def encode(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, _enc(F.col(text_col)))
    return encode


# Models built by ``loaded_encoder``, one per key per Python worker process.
_MODELS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def loaded_encoder(key: str, loader: Callable[[], Callable[[list[str]], list[list[float]]]],
                   dim: int = EMBEDDING_DIM) -> Encoder:
    """A batch encoder whose model is built once per Python worker process:
    ``loader()`` (e.g. reading weights from a shared folder) runs on the
    first batch a worker sees and returns the batch encode function, which
    is kept under ``key`` for every later batch and task on that worker
    (Spark reuses Python workers).  Batches arrive as Arrow record batches."""
    def batch_fn(texts: list[str]) -> list[list[float]]:
        fn = _MODELS.get(key)
        if fn is None:
            fn = _MODELS[key] = loader()
        return fn(texts)
    return pandas_encoder(batch_fn, dim)


def embed(df: DataFrame, text_col: str = "corpus", out_col: str = "embedding",
          encoder: Encoder | None = None) -> DataFrame:
    return (encoder or hashed_encoder())(df, text_col, out_col)
