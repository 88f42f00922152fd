"""Words as 63-bit hashes, for the operators that compare many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import words


class Codes(dict):
    """Word -> 63-bit hash, remembered within a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word) >> 1
        return code


def codes_of(text: str, codes: Codes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(codes.__getitem__, w), np.int64, len(w))


def frequent(df: DataFrame, fraction: float, least: int = 1) -> tuple[dict[int, float], int]:
    """({code: share of texts}, texts): words in more than ``fraction`` of the texts of a single-column frame, and in more than ``least``.

    Counts cover every text. The result's size is bounded by (mean distinct words of a text) / fraction, whatever the number of texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, held, n = Codes(), [], 0
        size = 0

        def flush() -> pd.DataFrame:
            c, k = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pd.DataFrame({"code": np.append(c, -1), "n": np.append(k, n)})  # -1: the number of texts

        for b in batches:
            for text in b.iloc[:, 0]:
                if text:
                    c = np.unique(codes_of(text, codes))
                    if len(c):
                        held.append(c)
                        n += 1
                        size += len(c)
                if size > 2_000_000:
                    yield flush()
                    held, n, size = [], 0, 0
        yield flush()

    totals = df.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).persist()
    try:
        texts = (totals.where("code = -1").select("n").first() or [0])[0]
        rows = totals.where((F.col("code") >= 0) & (F.col("n") > F.greatest(F.lit(texts * fraction), F.lit(float(least))))).toPandas()
    finally:
        totals.unpersist()
    return dict(zip(rows["code"].tolist(), (rows["n"] / max(texts, 1)).tolist())), texts
