"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of whole texts; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        own.encode_special_tokens = True
        for batch in texts:
            out = []
            values = [t or "" for t in batch]
            for at in range(0, len(values), 64):  # few encodings at once: they are many times as large as the texts
                out += [len(e) for e in own.encode_batch_fast(values[at : at + 64], add_special_tokens=False)]
            yield pd.Series(out, dtype="int64")

    return df.withColumn(name, count(F.col(text)))
