"""Quality rules: fixed text statistics, and a hashed n-gram classifier with calibrated
probabilities that judges the documents the fixed rules let through.

The classifier is logistic regression over hashed words and hashed character n-grams, runs
of three code points. A document's score is the mean weight of its words, plus the mean
weight of its runs, plus a bias. It is fitted, in one task, on at most SAMPLE labelled documents a
class (the ones with the smallest id hashes) and calibrated on a fifth of them that the
fit doesn't see (Platt's method). The model is a fixed 2 * BUCKETS floats, so it travels
in the closure; scoring is one pass of numpy over Arrow batches of whole texts.

Null and empty texts have no words and fail the fixed rules. Without labels of both
classes nothing can be learned and only the fixed rules decide (probability 1). An id that
is labelled both ways teaches nothing; of several texts of one labelled id the least one
is learned from. Rows that repeat, and rows with a null id, are judged each on its own;
labels with a null id or another value than 0 and 1 don't count. Other columns don't matter,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.textbatch import Block, blocks, mix, segment_reduce, window_hash

#: Weights for words, and as many again for runs of characters.
BUCKETS = 1 << 16
#: Labelled documents a class that the classifier is fitted on.
SAMPLE = 3000
#: A document is kept if its probability of being good is at least this.
KEEP_FROM = 0.5
EPOCHS = 8
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys made distinct between documents."""
    return mix(keys + doc.astype(np.uint64) * _ODD)


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """STATS of each document of a block, with the word spans' hashes as `word_hash`."""
    start, end = block.words()
    n_words = block.count_in(start)
    doc = np.repeat(np.arange(len(block)), n_words)
    prefix = block.prefix_hash()
    word_hash = block.span_hash(prefix, start, end)

    lead = (block.data & 0xC0) != 0x80
    chars = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    word_chars = segment_reduce(np.add, chars[end] - chars[start], n_words, 0)

    # Lines with a word, equal to an earlier one of the same document.
    newline = np.flatnonzero(block.data == 10)
    line_start = np.unique(np.concatenate((newline + 1, block.offsets[:-1])))
    line_doc = np.searchsorted(block.offsets, line_start, side="right") - 1
    last = np.searchsorted(newline, line_start)
    stops = np.concatenate((newline, [len(block.data)]))
    line_end = np.minimum(stops[last], block.offsets[np.minimum(line_doc + 1, len(block))])
    line_end = np.maximum(line_end, line_start)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    keys = _in_doc(block.span_hash(prefix, line_start, line_end), line_doc)
    _, firsts = np.unique(keys, return_index=True)
    n_dup = np.bincount(line_doc, minlength=len(block)) - np.bincount(line_doc[firsts], minlength=len(block))

    # Words covered by a window of five words that occurs again in the same document.
    repeat = np.zeros(len(block), np.int64)
    if len(word_hash) >= WINDOW:
        inside = doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        keys = _in_doc(window_hash(word_hash, WINDOW)[at], doc[at])
        ordered = np.sort(keys)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            place = np.minimum(np.searchsorted(again, keys), len(again) - 1)
            hit = at[again[place] == keys]
            covered = np.zeros(len(word_hash), bool)
            for k in range(WINDOW):
                covered[hit + k] = True
            repeat = np.bincount(doc[covered], minlength=len(block))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": block.sums(_SYMBOL[block.data]),
        "n_dup_lines": n_dup, "n_repeat_words": repeat, "word_hash": word_hash, "word_doc": doc, "prefix": prefix,
    }


RUN = 3


def char_runs(block: Block, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of RUN code points within documents, in order, and how many each
    document has."""
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    chars = block.count_in(lead)
    count = np.maximum(chars - RUN + 1, 0)
    doc = np.repeat(np.arange(len(block)), chars)
    m = max(0, len(lead) - RUN + 1)
    at = np.flatnonzero(doc[:m] == doc[RUN - 1 : RUN - 1 + m])
    end = np.concatenate((lead, [len(block.data)]))[at + RUN]
    return (block.span_hash(prefix, lead[at], end) % np.uint64(BUCKETS)).astype(np.int64), count


@dataclass
class Model:
    weights: np.ndarray  # of words, then of runs of characters; float32
    bias: float
    scale: float
    shift: float

    def probability(self, block: Block, stats: dict[str, np.ndarray]) -> np.ndarray:
        n = stats["n_words"]
        words = segment_reduce(np.add, self.weights[(stats["word_hash"] % np.uint64(BUCKETS)).astype(np.int64)], n, 0)
        run, count = char_runs(block, stats["prefix"])
        runs = segment_reduce(np.add, self.weights[BUCKETS + run].astype(np.float64), count, 0)
        score = words / np.maximum(n, 1) + runs / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.shift, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """At most SAMPLE labelled documents a class: label, text, fold."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"), F.max(F.col(label).cast("int")).alias("_other"))
    # Only labels of documents that are there count for the sample.
    marked = marked.where("_label = _other").join(docs.select(F.col(key).alias("_id")), "_id", "left_semi").select("_id", "_label", F.xxhash64("_id").alias("_order"))
    share = {r["_label"]: min(1.0, 1.3 * SAMPLE / r["n"]) for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if set(share) != {0, 1}:
        return None
    # The hash is uniform over 64 bits, so a slice of its range holds about that share.
    low = -(2**63)
    cut = F.when(F.col("_label") == 1, F.lit(int(low + share[1] * (2**64 - 1)) if share[1] < 1 else 2**63 - 1)).otherwise(
        F.lit(int(low + share[0] * (2**64 - 1)) if share[0] < 1 else 2**63 - 1)
    )
    first = Window.partitionBy("_label").orderBy("_order", "_id")
    chosen = (
        marked.where(F.col("_order") <= cut).withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= SAMPLE).select("_id", "_label", "_order")
    )
    # At most 2 * SAMPLE rows of three numbers: small enough to broadcast by construction.
    return (
        docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text"))
    )


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A labelled text's buckets and their shares."""
    for batch in batches:
        bucket, share = [], []
        for block in blocks(batch.column(1)):
            stats = block_stats(block)
            words = (stats["word_hash"] % np.uint64(BUCKETS)).astype(np.int64)
            run, count = char_runs(block, stats["prefix"])
            ends, run_ends = np.cumsum(stats["n_words"]), np.cumsum(count)
            for i in range(len(block)):
                w, c = words[ends[i] - stats["n_words"][i] : ends[i]], run[run_ends[i] - count[i] : run_ends[i]]
                wi, wn = np.unique(w, return_counts=True)
                ci, cn = np.unique(c, return_counts=True)
                bucket.append(np.concatenate((wi, ci + BUCKETS)).astype(np.int32).tobytes())
                share.append(np.concatenate((wn / max(len(w), 1), cn / max(len(c), 1))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(3), pa.array(bucket, pa.binary()), pa.array(share, pa.binary())],
            ["label", "fold", "bucket", "share"],
        )


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("fold", kind="stable")
    held = (rows["fold"].to_numpy() % 5) == 0
    x = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for b, s in zip(rows["bucket"], rows["share"])]
    y = rows["label"].to_numpy(float)
    weights, seen = np.zeros(2 * BUCKETS, np.float32), np.full(2 * BUCKETS, 1e-8, np.float32)
    bias, bias_seen = 0.0, 1e-8
    rng = np.random.default_rng(7)
    fit = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            b, s = x[i]
            g = 1 / (1 + np.exp(-np.clip(weights[b] @ s + bias, -40, 40))) - y[i]
            step = g * s
            seen[b] += step * step
            weights[b] -= 0.3 * step / np.sqrt(seen[b])
            bias_seen += g * g
            bias -= 0.3 * g / np.sqrt(bias_seen)
    score = np.array([weights[b] @ s + bias for b, s in x])
    use = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    s, t = score[use], y[use]
    good, bad = t.sum(), len(t) - t.sum()
    target = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))  # Platt's smoothed targets
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(scale * s + shift, -40, 40)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ s, d.sum()])
        hess = np.array([[v @ (s * s) + 1e-6, v @ s], [v @ s, v.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - np.clip(move[0], -5, 5), shift - np.clip(move[1], -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    about = {"bias": float(bias), "scale": float(scale), "shift": float(shift)}
    return pd.DataFrame({"weights": [weights.tobytes()], "about": [json.dumps(about)]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The classifier, or None if the labels don't hold both classes."""
    sample = _sample(docs, labels, key, text, label)
    if sample is None:
        return None
    rows = sample.select("_id", "_text", "_label", F.pmod(F.col("_order"), F.lit(1 << 40)).alias("_fold")).mapInArrow(
        _sparse, "label int, fold bigint, bucket binary, share binary"
    )
    got = rows.groupBy().applyInPandas(_train, "weights binary, about string").collect()  # one row of fixed size
    if not got:
        return None
    about = json.loads(got[0]["about"])
    return Model(np.frombuffer(got[0]["weights"], np.float32), about["bias"], about["scale"], about["shift"])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five statistics, base_failed, probability and kept: a row a row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {k: [np.zeros(0)] for k in [*STATS, "probability"]}
            for block in blocks(batch.column(1)):
                stats = block_stats(block)
                for k in STATS:
                    parts[k].append(stats[k])
                parts["probability"].append(model.probability(block, stats) if model else np.ones(len(block)))
            v = {k: np.concatenate(x) for k, x in parts.items()}
            n, repeat = v["n_words"], v["n_repeat_words"]
            failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (v["probability"] >= KEEP_FROM)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v[k].astype(np.int64)) for k in STATS), pa.array(failed), pa.array(v["probability"]), pa.array(kept)],
                [key, *STATS, "base_failed", "probability", "kept"],
            )

    schema = f"`{key}` {kind}, {', '.join(f'{k} bigint' for k in STATS)}, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def filter_good(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, all columns as they were, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for block in blocks(batch.column(text)):
                stats = block_stats(block)
                p = model.probability(block, stats) if model else np.ones(len(block))
                n, repeat = stats["n_words"], stats["n_repeat_words"]
                keep.append((n >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT_PERCENT * n) & (p >= KEEP_FROM))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
