"""Where models plug in: a scorer takes and gives Arrow-backed pandas frames, loaded once a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def run_model(rows: DataFrame, load: Callable[[], Scorer], schema: str, batch: int = 32) -> DataFrame:
    """Apply a scorer to rows in batches; load runs once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield score(frame.iloc[at : at + batch])

    return rows.mapInPandas(run, schema)


def mock_judge() -> Scorer:
    """A stand-in for tests: scores 1 to 5 from a hash of the response. It measures nothing."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        h = [int(hashlib.sha256(str(x).encode()).hexdigest()[:8], 16) for x in frame["response"]]
        return pd.DataFrame({"key": frame["key"], "judge_correctness": [1 + x % 5 for x in h], "judge_model": "mock"})

    return score


def mock_embedder(dim: int = 64) -> Scorer:
    """A stand-in embedding: hashed bag of words, unit length."""
    import numpy as np

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text in frame["text"]:
            v = np.zeros(dim)
            for w in str(text or "").lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[h % dim] += 1 if h >> 16 & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return pd.DataFrame({"id": frame["id"], "embedding": out})

    return score
