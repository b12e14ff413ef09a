"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of other non-space characters, as they are written; features are the presence
of tokens and of pairs of neighbours, hashed to 20 bits, and one shared feature each for a run of three and of six equal
tokens (the n-gram of any word with itself). Scores are sigmoids of sparse dot products.

Defined cases: null and empty texts have no features and score what the bias gives; rows with a null id are scored and
not learned from; repeated rows score alike; without labels every score is one half; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame

from meetlens.llm import ftrl

SETTINGS = ftrl.Settings(alpha=0.5, l1=2.0, epochs=5)
SPANS = ((0,), (0, 1))
RUNS = (3, 6)
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def features(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    hashes = ftrl.token_hashes(_TOKEN.findall(text.encode()))
    same = hashes[1:] == hashes[:-1]
    runs = [k for k, n in enumerate(RUNS) if len(same) >= n - 1 and np.logical_and.reduce([same[i : len(same) - n + 2 + i] for i in range(n - 1)]).any()]
    return np.union1d(ftrl.grams(hashes, SPANS, SETTINGS.bits), np.array(runs, np.uint32))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = ftrl.TRAIN_ROWS) -> ftrl.Model:
    """learn_from: a condition on doc_id; `rows` bounds the sample that the model is fitted on."""
    return ftrl.fit(ftrl.sample(docs, labels, "quality", learn_from, rows), features, SETTINGS, rows)


def score(docs: DataFrame, model: ftrl.Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    return ftrl.score(docs, model, features, keep, prefix)
