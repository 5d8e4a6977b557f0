"""Personal data: fixed patterns, and identifiers found through the contexts of known ones.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. They are the
seeds of a bootstrap over the whole corpus:

1. One pass over the texts lists the fillers: the fixed patterns' matches, and the other
   words that look like identifiers (a digit, four characters or more). A filler has up to
   five patterns: the word before it, the two words before, the word after, the two words
   after (lower case, without punctuation around them), and its shape (runs of digits by
   their length, runs of letters, long hexadecimal strings by their length; none for a word
   with the form of a card or IP number that fails its test).
2. Spark scores the graph of patterns and distinct fillers. A seed's confidence is 1. A
   pattern is induced by SUPPORT distinct fillers of confidence ACCEPT or more; its own
   confidence is the sum of its fillers' confidences over the number of its fillers and
   one. A filler that is no seed takes the best confidence of its induced patterns, and
   those that reach ACCEPT induce patterns in the next round, up to ROUNDS of them. So a
   label that stands before unknown identifiers is learned once enough of these are known
   by other contexts, and its confidence tends to the mean of what the others say of them.
3. Patterns of confidence ACCEPT or more mark all fillers they fit, as kind `id`. Spans of
   the fixed patterns stay; an `id` never meets one.

All fillers and patterns count, however many there are: distinct ones, so that copies of a
text carry no more weight than it. Up to MOST accepted patterns are broadcast; of more,
tasks get a bitmap of hashes of at most MOST_BITS bits, and what passes it goes in a join.

Offsets are in code points, end exclusive. Null and empty texts hold no spans. A kind's
matches never overlap, those of different kinds may. Rows that repeat give rows, null ids
too; other columns don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textbatch import blocks
from tallyloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
MOST = 10_000
MOST_BITS = 1 << 26
ROUNDS = 8
ACCEPT = 0.6
_FLAG = np.zeros(256, bool)
_FLAG[[*range(0x30, 0x3A), ord("@")]] = True
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so this finds what the plain
# pattern finds, without trying each digit of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BARE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_HEX = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one @, with all the local characters before it that no earlier
    match took; so each @ is looked at once, however long the words are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace")) - 2**63


def _shape(value: str) -> str:
    if _HEX.fullmatch(value):
        return f"x{len(value)}"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>", value))


def _refused(value: str) -> bool:
    """Whether a word without a fixed match has the form of one, and so failed its test."""
    return bool(_CARD.fullmatch(value)) and 14 <= len(_NOT_DIGIT.sub("", value)) <= 19 or bool(_IP.fullmatch(value))


def fillers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(start, kind, end, value, patterns) of the fixed matches and of other words like identifiers
    (kind 4), which never meet a fixed match."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    plain: dict[int, str] = {}

    def word(k: int) -> str:
        if k not in plain:
            own = text[words[k][0] : words[k][1]].lower()
            bare = _BARE.search(own)
            plain[k] = bare[0] if bare else own
        return plain[k]

    spans = list(base)
    taken = sorted((s, e) for s, _, e in base)
    at = 0
    for a, b in words:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        own = text[a:b]
        if not any("0" <= c <= "9" for c in own):
            continue
        bare = _BARE.search(own)
        s, e = a + bare.start(), a + bare.end()
        # Fixed matches of different kinds may lie within each other, so look further than one.
        if e - s >= 4 and all(e <= x or y <= s for x, y in taken[max(0, at - 8) :][:32] if x < e):
            spans.append((s, 4, e))
    out = []
    for s, k, e in sorted(spans):
        i, j = bisect.bisect_right(starts, s) - 1, bisect.bisect_left(starts, e) - 1
        value = text[s:e].lower()
        # A shape alone must not mark what the fixed pattern of that shape refuses.
        patterns = [] if k == 4 and _refused(value) else [_hash("shape", _shape(value))]
        if i >= 1:
            patterns.append(_hash("left", word(i - 1)))
        if i >= 2:
            patterns.append(_hash("left", word(i - 2), word(i - 1)))
        if j + 1 < len(words):
            patterns.append(_hash("right", word(j + 1)))
        if j + 2 < len(words):
            patterns.append(_hash("right", word(j + 1), word(j + 2)))
        out.append((s, k, e, value, tuple(patterns)))
    return out


def _marked(col: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows and texts that hold a digit or an @."""
    for block in blocks(col):
        for i in np.flatnonzero(block.sums(_FLAG[block.data]) > 0):
            yield block.first + int(i), col[block.first + int(i)].as_py()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, value, seed) of each filler."""
    for batch in batches:
        pattern, value, seed = [], [], []
        for _, text in _marked(batch.column(0)):
            for _, k, _, own, patterns in fillers(text, base_spans(text)):
                h = _hash(own)
                pattern += patterns
                value += [h] * len(patterns)
                seed += [k < 4] * len(patterns)
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(value, pa.int64()), pa.array(seed, pa.bool_())], ["pattern", "value", "seed"])


def _bitmap(table: DataFrame, n: int) -> np.ndarray:
    """Bits of the patterns' hashes, in words of 64."""
    size = min(MOST_BITS, 1 << max(20, (64 * n).bit_length()))
    words = table.groupBy(F.expr(f"shiftright(pattern & {size - 1}, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pattern & 63 AS int)))").alias("bits"))
    rows, out = words.toArrow(), np.zeros(size >> 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _may_be(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[(h & (len(bits) * 64 - 1)) >> 6] >> (h & 63)) & 1 > 0


class Patterns:
    """A table of patterns' hashes; `few` has them sorted if there are MOST at most, else it is None."""

    def __init__(self, table: DataFrame, n: int) -> None:
        self.table, self.n = table, n
        self.few = frozenset(r[0] for r in table.collect()) if n <= MOST else None

    def __len__(self) -> int:
        return self.n


def score(edges: DataFrame) -> DataFrame:
    """pattern, p: the confidences of the induced patterns. edges: distinct (pattern, value), and
    whether the value is a seed."""
    # Fewer fillers than SUPPORT never induce a pattern.
    some = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    edges = materialize(edges.join(some, "pattern"), "edges")
    sure = edges.groupBy("value").agg(F.max("seed").cast("double").alias("c"))
    for k in range(ROUNDS):
        found = edges.join(sure, "value").groupBy("pattern").agg(F.sum("c").alias("good"), F.count(F.when(F.col("c") >= ACCEPT, 1)).alias("support"), F.max("n").alias("n"))
        scores = materialize(found.where(F.col("support") >= SUPPORT).select("pattern", (F.col("good") / (F.col("n") + 1)).alias("p")), "scores")
        if k + 1 < ROUNDS:
            sure = edges.join(scores, "pattern", "left").groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("p"), F.lit(0.0))).alias("c"))
    return scores


def learn_patterns(docs: DataFrame, text: str = "text") -> Patterns:
    """The accepted patterns."""
    body = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    edges = body.mapInArrow(_edges, "pattern bigint, value bigint, seed boolean").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    accepted = score(materialize(edges, "fillers")).where(F.col("p") >= ACCEPT).select("pattern")
    return Patterns(accepted, accepted.count())


def _unused(docs: DataFrame, name: str) -> str:
    """name, longer if docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_own(docs: DataFrame, patterns: Patterns, text: str) -> tuple[DataFrame, str]:
    """docs and, if there are too many patterns to broadcast, a column with those that occur
    in the text; its name."""
    named = _unused(docs, "_pii_own")
    if patterns.few is not None:
        return docs, named
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(patterns.table, patterns.n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pattern = [], []
            for i, t in _marked(batch.column(2)):
                for _, k, _, _, patterns in fillers(t, base_spans(t)):
                    if k == 4:
                        row += [i] * len(patterns)
                        pattern += patterns
            h = np.array(pattern, np.int64)
            use = _may_be(h, shared.value)
            at = pa.array(np.array(row, np.int64)[use])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[use])], ["_pii_a", "_pii_b", "pattern"])

    a, b = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    body = docs.where(F.col(text).isNotNull()).select(a.alias("_pii_a"), b.alias("_pii_b"), F.col(text).alias("t"))
    own = body.mapInArrow(run, "_pii_a bigint, _pii_b bigint, pattern bigint").distinct().join(patterns.table, "pattern")
    # Written first, so that the join below may split a text that many rows hold.
    own = materialize(own.groupBy("_pii_a", "_pii_b").agg(F.collect_list("pattern").alias("_pii_own")), "own")
    ka, kb = _unused(docs, "_pii_a"), _unused(docs, "_pii_b")
    own = own.select(F.col("_pii_a").alias(ka), F.col("_pii_b").alias(kb), F.col("_pii_own").alias(named))
    return docs.withColumns({ka: a, kb: b}).join(own, [ka, kb], "left").select(*docs.columns, named), named


def _all_spans(batch: pa.RecordBatch, at: int, few: frozenset | None, named: str) -> Iterator[tuple[int, str, list, list]]:
    """For each text with any: (row, text, base spans, id spans)."""
    for i, text in _marked(batch.column(at)):
        base = base_spans(text)
        patterns = few if few is not None else set(batch.column(named)[i].as_py() or [])
        more = [(s, 4, e) for s, k, e, _, own in fillers(text, base) if k == 4 and not patterns.isdisjoint(own)] if patterns else []
        if base or more:
            yield i, text, base, more


_NAMES = (*KINDS, "id")


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{_NAMES[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, patterns: Patterns, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans (of all kinds): a row a row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    nothing, few = hashlib.sha256(b"").hexdigest(), patterns.few
    rows, named = _with_own(docs.select(F.col(key), F.col(text)), patterns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, sha, spans = np.zeros((n, 5), np.int64), [nothing] * n, [""] * n
            for i, _, base, more in _all_spans(batch, 1, few, named):
                for _, k, _ in base + more:
                    counts[i, k] += 1
                sha[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[i] = _join(sorted(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k].copy()) for k in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, 4].copy()), pa.array(counts.sum(axis=1))],
                [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_id", "n_spans"],
            )

    schema = f"`{key}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_id bigint, n_spans bigint"
    return rows.mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span as [KIND]; spans that overlap become the first one's."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{_NAMES[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, patterns: Patterns, text: str = "text") -> DataFrame:
    """docs with all spans replaced; other columns as they were."""
    few, columns = patterns.few, docs.columns
    rows, named = _with_own(docs, patterns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            changed = {i: redact_text(t, base + more) for i, t, base, more in _all_spans(batch, at, few, named)}
            if changed:
                texts = batch.column(at).to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(columns)

    return rows.mapInArrow(run, docs.schema)
