"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams are the runs of one, two and three code points of the lower-cased text,
hashed into BUCKETS columns. The model is the matrix of log probabilities (one row a
language, so a fixed size a language), broadcast to the tasks; each Arrow batch is scored
by gathers from it and sums over documents.

It is fitted on a sample of about SAMPLE documents a language (all, where there are
fewer), the ones whose id hashes fall in a slice of the hash range. A text that is null
or holds no letter gets UNKNOWN with score 0; so does every text if nothing was learned.
Equally probable languages: the first by name. Rows that repeat, and rows with a null id,
are predicted each on its own, but a null id teaches nothing. Other columns don't matter,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16  # the top bits of a 32-bit hash
SAMPLE = 2000
SMOOTHING = 0.1
UNKNOWN = "und"
#: Code points handled at a time.
BLOCK = 1 << 19
_MULTIPLIERS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, offsets) of runs of whole texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        points = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, points, np.concatenate(([0], np.cumsum([len(t) for t in texts[i:j]])))
        i = j


def _grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at each position, and whether the n-gram stays in its text."""
    n = len(points)
    for order in ORDERS:
        m = n - order + 1
        if m <= 0:
            continue
        h = np.full(m, order, np.uint32)
        for k in range(order):
            h = (h ^ points[k : k + m]) * _MULTIPLIERS[k]
        ok = np.ones(m, bool)
        for k in range(1, order):
            edge = offsets[1:-1] - k
            ok[edge[(edge >= 0) & (edge < m)]] = False
        yield h >> np.uint32(16), ok


def _lower(texts: list[str | None]) -> list[str]:
    return [t.lower() if t else "" for t in texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language of a task's sample, as (bucket, count) arrays."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = _lower(batch.column(0).to_pylist()), batch.column(1).to_pylist()
        for lang in set(langs):
            own = [t for t, at in zip(texts, langs) if at == lang]
            held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs[lang] = docs.get(lang, 0) + len(own)
            for _, points, offsets in _blocks(own):
                for bucket, ok in _grams(points, offsets):
                    held += np.bincount(bucket[ok], minlength=BUCKETS)
    langs = sorted(counts)
    some = [np.flatnonzero(counts[x]) for x in langs]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()), pa.array([docs[x] for x in langs], pa.int64()),
            pa.array([b.astype(np.int32).tobytes() for b in some], pa.binary()),
            pa.array([counts[x][b].tobytes() for x, b in zip(langs, some)], pa.binary()),
        ],
        ["lang", "docs", "bucket", "n"],
    )


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One language's counts, added up."""
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in zip(rows["bucket"], rows["n"]):
        total[np.frombuffer(bucket, np.int32)] += np.frombuffer(n, np.int64)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "docs": [int(rows["docs"].sum())], "n": [total.tobytes()]})


class Model:
    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.log_prob, self.prior = langs, log_prob, prior


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model of the languages that docs' rows name; rows with a null lang, text or key
    teach nothing. The caller leaves out the rows that are held out."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    count = {r[0]: r[1] for r in named.groupBy(F.col(lang)).agg(F.count("*")).collect()}  # a row a language
    low, span = -(2**63), 2**64 - 1
    share = F.lit(2**63 - 1)
    for name, n in count.items():
        if n > SAMPLE:
            share = F.when(F.col(lang) == name, F.lit(int(low + span * SAMPLE / n))).otherwise(share)
    sample = named.where(F.xxhash64(F.col(key)) <= share).select(F.col(text).alias("t"), F.col(lang).alias("lang"))
    rows = (
        sample.mapInArrow(_count, "lang string, docs bigint, bucket binary, n binary")
        .groupBy("lang").applyInPandas(_merge, "lang string, docs bigint, n binary").collect()
    )
    rows.sort(key=lambda r: r["lang"])
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    n = np.array([np.frombuffer(r["n"], np.int64) for r in rows], float) + SMOOTHING
    log_prob = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
    # The sample is balanced by design; the prior is that of all rows.
    prior = np.array([count[r["lang"]] for r in rows], float)
    return Model([r["lang"] for r in rows], log_prob, np.log(prior / prior.sum()))


def classify_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The most probable language of each text (ties: the first by name) and its posterior."""
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return pred, score
    lowered = _lower(texts)
    for first, points, offsets in _blocks(lowered):
        logs = np.tile(model.prior, (len(offsets) - 1, 1))
        total = np.zeros(len(points) + 1)
        for bucket, ok in _grams(points, offsets):
            for k in range(len(model.langs)):
                value = model.log_prob[k][bucket]
                value[~ok] = 0
                np.cumsum(value, dtype=np.float64, out=total[1 : len(value) + 1])
                total[len(value) + 1 :] = total[len(value)]
                logs[:, k] += total[offsets[1:]] - total[offsets[:-1]]
        best = logs.argmax(axis=1)
        odds = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i in range(len(best)):
            if any(map(str.isalpha, texts[first + i] or "")):
                pred[first + i], score[first + i] = model.langs[best[i]], float(odds[i])
    return pred, score


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score: a row a row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.log_prob, model.prior))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            pred, score = classify_texts(own, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
