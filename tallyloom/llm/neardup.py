"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity.

A text's shingles are its runs of five words (A-Z in lower case; a text of fewer words has
one shingle of all of them). A shingle weighs tf * idf, with

    idf = 1 + DAMPING * ln((1 + N) / (1 + df)) / ln(1 + N).

The damping is needed: the shingles that a large group of near copies shares are frequent,
and with a plain idf the few words in which two copies differ would outweigh all they have
in common. df is counted over all documents in DF_BUCKETS hashed counters, a table of fixed
size; a shingle's df is overestimated by about (shingles a document / DF_BUCKETS) * N, the
same share of N at every N.

1. Equal texts become one node.
2. Improved consistent weighted sampling draws BANDS * ROWS samples of each text; two
   texts agree in one with the probability of their weighted Jaccard similarity. A node
   gets a key a band. Two nodes of a bucket are a candidate pair if they share AGREE
   samples or more.
3. In each bucket (band, key) the node with the most company is the pivot; its candidate
   pairs are verified by exact weighted Jaccard over whole texts. Pairs of THRESHOLD or
   more are links. That settles most of a large group in rows linear in its size.
4. All other candidate pairs whose texts are not yet in one component are verified in
   blocks: the members of a bucket that are outside of its largest component, about CHUNK
   at a time, meet about CHUNK members at a time. Tasks first find the members that have
   such a pair by samples alone; only these go with their texts into a second pass, where
   the shingles common to a block are multiplied as matrices. A task returns members or a
   forest of links, never pairs; each pair is looked at in the first band it shares.
5. Components of links are classes; the class id is the smallest document id in it.

Equal texts are one class whatever they hold, so texts without a word (empty, white space)
are in one class with equal ones and with no others: they have no shingles. A null text is
a class of its own. Rows with a null id get a null class and take no part. Rows that share
an id are in one class, whatever their texts. Other columns, whatever their names,
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textbatch import Block, blocks, mix, window_hash
from tallyloom.plans.components import connected_components
from tallyloom.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Samples that a pair must share to be compared further: a pair of THRESHOLD shares 24 of
#: the 30 on average, and fewer than this with probability 0.0005.
AGREE = 17
DAMPING = 0.1
DF_BUCKETS = 1 << 16
#: Rows of a bucket in one side of a block, on average; a row more for each LONG bytes.
CHUNK = 192
LONG = 1 << 14
_CHUNKS = 16
_DOC_BITS = 14
_MASK = np.uint64((1 << (64 - _DOC_BITS)) - 1)
_gamma = np.sort(np.random.default_rng(99).gamma(2.0, 1.0, 1 << 16))
_GAMMA = _gamma[np.random.default_rng(98).permutation(1 << 16)]
_LOG_GAMMA = np.log(_GAMMA)
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block in document order: (document, hash of 50 bits, tf)."""
    start, end = block.words()
    n_words = block.count_in(start)
    h = block.span_hash(block.prefix_hash(), start, end)
    ends = np.cumsum(n_words)
    doc = np.repeat(np.arange(len(block)), n_words)
    full = window_hash(h, SHINGLE)
    inside = doc[: len(full)] == doc[SHINGLE - 1 :] if len(full) else np.zeros(0, bool)
    parts, owners = [full[inside]], [doc[: len(full)][inside]]
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        parts.append(window_hash(h[ends[i] - n_words[i] : ends[i]], int(n_words[i])))
        owners.append(np.array([i]))
    s, d = np.concatenate(parts), np.concatenate(owners).astype(np.uint64)
    key = np.sort((d << np.uint64(64 - _DOC_BITS)) | (s & _MASK))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return (key >> np.uint64(64 - _DOC_BITS)).astype(np.int64), key & _MASK, tf


def _blocks(col: pa.Array) -> Iterator[Block]:
    """Blocks of fewer documents than _DOC_BITS can number."""
    for block in blocks(col, lower=True, most=1 << 19):
        step = (1 << _DOC_BITS) - 1
        for a in range(0, len(block), step):
            off = block.offsets[a : a + step + 1]
            yield Block(block.first + a, block.data[off[0] : off[-1]], off - off[0])


def _bucket(s: np.ndarray) -> np.ndarray:
    return (mix(s) % np.uint64(DF_BUCKETS)).astype(np.int64)


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DF_BUCKETS, np.int64)
    for batch in batches:
        for block in _blocks(batch.column(0)):
            _, s, _ = _shingles(block)
            total += np.bincount(_bucket(s), minlength=DF_BUCKETS)
    if total.any():
        rows = total.reshape(_CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "n"])


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in rows["n"])
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "n": [total.tobytes()]})


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Hashed counters of the documents that hold a shingle; DF_BUCKETS numbers."""
    kind = "chunk int, n binary"
    part = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(_count_df, kind)
    # In two levels, so that no task meets the tables of all others.
    part = part.withColumn("some", F.spark_partition_id() % 64).groupBy("chunk", "some").applyInPandas(_add_up, kind)
    rows = part.groupBy("chunk").applyInPandas(_add_up, kind).collect()
    out = np.zeros((_CHUNKS, DF_BUCKETS // _CHUNKS), np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


class Weights:
    """idf by hashed df."""

    def __init__(self, df: np.ndarray, n: int) -> None:
        self.idf = 1 + DAMPING * np.clip(np.log((1 + n) / (1 + df)), 0, None) / np.log(2 + n)

    def of(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[_bucket(s)]


def draw_samples(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their BANDS * ROWS samples as 32-bit hashes)."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.int32)
    counts = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero(counts)
    starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    log_w = np.log(weight)
    out = np.zeros((len(some), BANDS * ROWS), np.int32)
    for k in range(BANDS * ROWS):
        h = mix(s ^ _SALTS[k])
        r = _GAMMA[h & np.uint64(0xFFFF)]
        beta = (h >> np.uint64(32)) * (1 / 2**32)
        t = np.floor(log_w / r + beta)
        # ln a, where a = c / (y * e**r) and y = e**(r * (t - beta)); the smallest wins
        log_a = _LOG_GAMMA[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        out[:, k] = (mix(least.view(np.uint64) + np.uint64(k + 1)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return some, out


def weighted_jaccard(a: str, b: str, weights: Weights) -> float:
    # Long texts are in blocks of their own.
    parts = [(block.first, *_shingles(block)) for block in _blocks(pa.array([a, b], pa.large_string()))]
    doc = np.concatenate([first + d for first, d, _, _ in parts])
    s, tf = (np.concatenate([x[k] for x in parts]) for k in (2, 3))
    w = weights.of(s, tf)
    sa, wa, sb, wb = s[doc == 0], w[doc == 0], s[doc == 1], w[doc == 1]
    if not len(sa) or not len(sb):
        return 0.0
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    both = sb[at] == sa
    x, y = wa[both], wb[at[both]]
    inter = np.minimum(x, y).sum()
    return float(inter / (wa.sum() + wb.sum() - inter))


def _signatures(docs: DataFrame, weights: Weights, key: str, text: str) -> DataFrame:
    """_k, _a, _b (128 bits of hash of the text), size, drawn (samples, null without words):
    a row a row of docs with an id and a text."""
    base = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_k"), *_text_hash(text), (1 + F.octet_length(F.col(text)) / LONG).cast("long").alias("size"), F.col(text).alias("_t")
    )
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for block in _blocks(batch.column(4)):
                doc, s, tf = _shingles(block)
                some, drawn = draw_samples(doc, s, shared.value.of(s, tf), len(block))
                for i, row in zip(some, drawn):
                    out[block.first + int(i)] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, pa.list_(pa.int32()))], ["_k", "_a", "_b", "size", "drawn"])

    return base.mapInArrow(run, f"_k {kind}, _a bigint, _b bigint, size bigint, drawn array<int>")


def _text_hash(text: str) -> list[Column]:
    return [F.xxhash64(F.col(text)).alias("_a"), F.xxhash64(F.lit(1), F.col(text)).alias("_b")]


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """The pairs (x, y) of THRESHOLD or more."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [weighted_jaccard(a, b, shared.value) >= THRESHOLD for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("x"), F.col("_t").alias("tx"))
    right = texts.select(F.col("node").alias("y"), F.col("_t").alias("ty"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x bigint, y bigint")


def _in_blocks(rows: DataFrame, size: Column) -> DataFrame:
    """rows (band, bucket, node, comp, ...) of buckets with more than one component, dealt
    to blocks: `ka`, `kb` number a bucket's blocks, `block` the task groups. In each block
    some members outside of the bucket's largest component meet some of all its members;
    small buckets have one block, and many of them share a group."""
    each = rows.groupBy("band", "bucket", "comp").agg(F.sum(size).alias("n"))
    whole = each.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("comp", "n").alias("major"), F.count("*").alias("comps"))
    parts = lambda n: F.ceil(n / CHUNK)
    whole = materialize(whole.where("comps > 1").select("band", "bucket", "major", "n", parts(F.col("n") - F.col("top")).alias("_a"), parts(F.col("n")).alias("_b")), "crowds")
    groups = (whole.agg(F.sum("n")).first()[0] or 0) // (4 * CHUNK) + 1
    placed = rows.join(whole, ["band", "bucket"]).withColumn("_h", F.xxhash64("node"))
    few = F.col("_b") == 1
    every = placed.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_a") - 1)).alias("ka"), F.pmod("_h", "_b").alias("kb"), few.alias("few"))
    minor = placed.where(~few & (F.col("comp") != F.col("major"))).select(
        *rows.columns, F.pmod("_h", "_a").alias("ka"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("kb"), few.alias("few")
    )
    block = F.when(F.col("few"), F.pmod(F.xxhash64("band", "bucket"), F.lit(groups))).otherwise(F.xxhash64("band", "bucket", "ka", "kb"))
    return every.unionByName(minor).withColumn("block", block).drop("few")


class _Rows:
    """The rows of a task group, each member once a block, sorted by block."""

    def __init__(self, table: pa.Table) -> None:
        columns = {c: table.column(c).to_numpy() for c in ("band", "bucket", "ka", "kb", "node", "comp", "pivot")}
        order = np.lexsort([columns[c] for c in ("node", "kb", "ka", "bucket", "band")])
        columns = {c: v[order] for c, v in columns.items()}
        cell = np.zeros(len(order), bool)
        for c in ("band", "bucket", "ka", "kb"):
            cell[1:] |= columns[c][1:] != columns[c][:-1]
        once = cell.copy()
        once[:1] = True
        once[1:] |= columns["node"][1:] != columns["node"][:-1]
        self.cell = np.cumsum(cell)[once]
        self.band, self.bucket, self.node, self.comp, self.pivot = (columns[c][once] for c in ("band", "bucket", "node", "comp", "pivot"))
        self.at = order[once]
        flat = table.column("drawn").combine_chunks().flatten().to_numpy()
        self.drawn = flat.reshape(table.num_rows, BANDS * ROWS)[self.at]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs of different components that no pivot was in, each in the first
        band that it shares."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, len(self.cell)):
            i = np.flatnonzero(self.cell[d:] == self.cell[:-d])
            if not len(i):
                break
            i = i[(self.comp[i] != self.comp[i + d]) & ~self.pivot[i] & ~self.pivot[i + d]]
            same = self.drawn[i] == self.drawn[i + d]
            use = same.sum(axis=1) >= AGREE
            i, same = i[use], same[use].reshape(-1, BANDS, ROWS).all(axis=2)
            i = i[same.argmax(axis=1) == self.band[i]]
            left.append(i)
            right.append(i + d)
        return np.concatenate(left), np.concatenate(right)


def _live(table: pa.Table) -> pa.Table:
    """The members that have a candidate pair."""
    rows = _Rows(table)
    some = np.unique(np.concatenate(rows.pairs()))
    return pa.table({c: pa.array(getattr(rows, c)[some]) for c in ("band", "bucket", "node")}, schema=pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64())]))


def _similarities(doc: np.ndarray, s: np.ndarray, tf: np.ndarray, weights: Weights, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of n texts, of which s and tf are the shingles."""
    order = np.lexsort((s, doc))
    doc, s, tf = doc[order], s[order], tf[order]
    idf = weights.of(s, np.ones(len(s)))
    total = np.bincount(doc, tf * idf, minlength=n)
    if len(left) <= 4 * n:
        ends = np.searchsorted(doc, np.arange(n + 1))
        both = np.zeros(len(left))
        for k, (i, j) in enumerate(zip(left, right)):
            a, b = slice(ends[i], ends[i + 1]), slice(ends[j], ends[j + 1])
            if ends[i] < ends[i + 1] and ends[j] < ends[j + 1]:
                at = np.minimum(np.searchsorted(s[b], s[a]), ends[j + 1] - ends[j] - 1)
                hit = s[b][at] == s[a]
                both[k] = (np.minimum(tf[a][hit], tf[b][at[hit]]) * idf[a][hit]).sum()
    else:
        # The l-th occurrence of a shingle is an item of its own: minima become products.
        rep = np.repeat(np.arange(len(s)), tf)
        level = np.arange(len(rep)) - np.repeat(np.cumsum(tf) - tf, tf)
        _, item, often = np.unique(np.stack((s[rep].view(np.int64), level)), axis=1, return_inverse=True, return_counts=True)
        item = item.reshape(-1)
        shared = often[item] > 1
        rep, item = rep[shared], item[shared]
        by_item = np.argsort(item, kind="stable")
        rep, item = rep[by_item], np.unique(item[by_item], return_inverse=True)[1]
        inter, width = np.zeros((n, n)), 4096
        for a in range(0, int(item[-1]) + 1 if len(item) else 0, width):
            part = slice(*np.searchsorted(item, [a, a + width]))
            x = np.zeros((n, width))
            x[doc[rep[part]], item[part] - a] = np.sqrt(idf[rep[part]])
            inter += x @ x.T
        both = inter[left, right]
    return both / np.maximum(total[left] + total[right] - both, 1e-300)


def _block_links(shared):
    """The links of a group's candidate pairs, as a forest over components."""

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table)
        left, right = rows.pairs()
        some = np.unique(np.concatenate((left, right)))
        texts = table.column("_t").take(pa.array(rows.at[some])).combine_chunks()
        parts = [(block.first, *_shingles(block)) for block in _blocks(texts)]
        doc = np.concatenate([np.zeros(0, np.int64), *[f + d for f, d, _, _ in parts]])
        s, tf = (np.concatenate([np.zeros(0, t), *[p[k] for p in parts]]) for k, t in ((2, np.uint64), (3, np.int64)))
        edges, cells = [], rows.cell[left]
        order = np.argsort(cells, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1) if len(order) else []:
            i, j = left[own], right[own]
            here = np.unique(np.concatenate((i, j)))
            at = np.searchsorted(some, here)
            which = np.full(len(some), -1)
            which[at] = np.arange(len(at))
            mine = which[doc] >= 0
            found = _similarities(which[doc[mine]], s[mine], tf[mine], shared.value, len(here), np.searchsorted(here, i), np.searchsorted(here, j)) >= THRESHOLD
            root: dict[int, int] = {}

            def top(c: int) -> int:
                while c in root:
                    c = root[c]
                return c

            for x, y in zip(i[found].tolist(), j[found].tolist()):
                p, q = top(int(rows.comp[x])), top(int(rows.comp[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((int(rows.node[x]), int(rows.node[y])))
        return pa.table({"x": pa.array([e[0] for e in edges], pa.int64()), "y": pa.array([e[1] for e in edges], pa.int64())})

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id: a row a row of docs."""
    spark = docs.sparkSession
    n = docs.where(F.col(text).isNotNull()).count()
    weights = Weights(document_frequencies(docs, text), n)
    signed = materialize(_signatures(docs, weights, key, text), "signatures")
    # Written first, so that the joins below may split a text that many rows hold.
    named = signed.groupBy("_a", "_b").agg(F.min("_k").alias("least"), F.any_value("size").alias("size"), F.any_value("drawn").alias("drawn"))
    named = materialize(named.withColumn("node", F.monotonically_increasing_id()), "named")
    members = materialize(signed.select("_k", "_a", "_b").distinct().join(named.select("_a", "_b", "node"), ["_a", "_b"]).select("_k", "node"), "members")
    keys = F.array(*[F.xxhash64(F.slice("drawn", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    banded = named.where("drawn IS NOT NULL").select("node", F.posexplode(keys).alias("band", "bucket"), "drawn", "size")
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(banded.join(shared, ["band", "bucket"]), "crowded")
    # The more company a node has in its buckets, the more central it is.
    degree = crowded.groupBy("node").agg(F.sum("n").alias("degree"))
    buckets = materialize(crowded.drop("n").join(degree, "node"), "buckets")
    pivots = materialize(buckets.groupBy("band", "bucket").agg(F.max(F.struct("degree", "node", "drawn")).alias("p")).select("band", "bucket", F.col("p.node").alias("p"), F.col("p.drawn").alias("pdrawn")), "pivots")

    # Whole texts of the nodes that share a bucket, once: those of their smallest id.
    need = named.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("_k"), "_a", "_b", "node")
    own = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), *_text_hash(text), F.col(text).alias("_t"))
    texts = materialize(own.join(need, ["_k", "_a", "_b"]).select("node", "_t").dropDuplicates(["node"]), "texts")

    # Pivots and the others of their buckets; a pair that meets in several buckets with the
    # same pivot comes up in the first of them.
    bands = pivots.groupBy("p").agg(F.collect_set("band").alias("pbands"))
    met_before = F.exists("pbands", lambda b: (b < F.col("band")) & (F.slice("drawn", b * ROWS + 1, ROWS) == F.slice("pdrawn", b * ROWS + 1, ROWS)))
    alike = F.size(F.filter(F.zip_with("drawn", "pdrawn", lambda x, y: x == y), lambda x: x)) >= AGREE
    met = buckets.join(pivots.join(bands, "p"), ["band", "bucket"]).where((F.col("p") != F.col("node")) & alike & ~met_before)
    links = materialize(_verified(met.select(F.col("p").alias("x"), F.col("node").alias("y")), texts, weights), "links")
    # The texts of one id belong together.
    several = members.groupBy("_k").agg(F.min("node").alias("x"), F.max("node").alias("hi")).where("x <> hi").select("_k", "x")
    links = links.unionByName(members.join(several, "_k").select("x", F.col("node").alias("y")))
    found = materialize(connected_components(links, "x", "y"), "components")

    # The rest, in blocks.
    rest = buckets.join(pivots.select("band", "bucket", "p"), ["band", "bucket"]).withColumn("pivot", F.col("p") == F.col("node"))
    rest = rest.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("band", "bucket", "node", "comp", "pivot", "drawn", "size")
    rest = materialize(rest, "rest")
    live = materialize(_in_blocks(rest, F.lit(1)).groupBy("block").applyInArrow(_live, "band int, bucket bigint, node bigint").distinct(), "live")
    open_ = rest.join(live, ["band", "bucket", "node"]).join(texts, "node")
    weighted = spark.sparkContext.broadcast(weights)
    more = materialize(_in_blocks(open_, F.col("size")).groupBy("block").applyInArrow(_block_links(weighted), "x bigint, y bigint"), "links")
    if not more.isEmpty():
        found = materialize(connected_components(more.unionByName(found.select(F.col("node").alias("x"), F.col("component").alias("y"))), "x", "y"), "components")

    placed = named.select("node", "least").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    placed = materialize(placed.select("node", "least", "comp"), "placed")
    names = placed.groupBy("comp").agg(F.min("least").alias("class_id"))
    by_doc = members.join(placed.join(names, "comp").select("node", "class_id"), "node").groupBy("_k").agg(F.min("class_id").alias("_c"))
    return docs.select(F.col(key).alias("_own")).join(by_doc, F.col("_own") == F.col("_k"), "left").select(F.col("_own").alias(key), F.coalesce("_c", "_own").alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is their class's: one document of each class. Rows with a
    null id stay; of rows that repeat an id and its class, all with the first text stay."""
    kept = classes(docs, key, text).where(F.col(key).isNotNull() & (F.col(key) != F.col("class_id"))).select(F.col(key).alias("_gone")).distinct()
    return docs.join(kept, docs[key] == kept["_gone"], "left_anti")
