"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Tokens are lower-cased runs of letters, digits and apostrophes; features are the presence of words, of pairs of neighbours,
of pairs with one word between, and of words cut to their first four and five bytes (so that an inflected form counts with
its stem), hashed to 20 bits. Per-coordinate rates and the L1 penalty leave few weights, which are broadcast as index and
value.

Defined cases: null and empty texts have no features and score what the bias gives; rows with a null id are scored and
not learned from; repeated rows score alike; without labels every score is one half; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame

from meetlens.llm import ftrl

SETTINGS = ftrl.Settings(alpha=1.0, l1=4.0, epochs=6)
SPANS = ((0,), (0, 1), (0, 2))
STEMS = (4, 5)
_TOKEN = re.compile(rb"[0-9a-z'\x80-\xff]+")


def features(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    words = _TOKEN.findall(text.lower().encode())
    found = [ftrl.grams(ftrl.token_hashes(words), SPANS, SETTINGS.bits)]
    found += [ftrl.grams(ftrl.token_hashes(list({w[:n] for w in words})), ((0,),), SETTINGS.bits, len(SPANS) + k) for k, n in enumerate(STEMS)]
    return np.unique(np.concatenate(found))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = ftrl.TRAIN_ROWS) -> ftrl.Model:
    """learn_from: a condition on doc_id; `rows` bounds the sample that the model is fitted on."""
    return ftrl.fit(ftrl.sample(docs, labels, "toxic", learn_from, rows), features, SETTINGS, rows)


def score(docs: DataFrame, model: ftrl.Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    return ftrl.score(docs, model, features, keep, prefix)
