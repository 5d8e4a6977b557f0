"""Operators over the whole corpus against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
import pyarrow as pa  # noqa: E402

from tallyloom.llm import linededup, neardup, packing, sharding, substring, topk  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, extra=False, parts=3):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).repartition(parts)
    return df.selectExpr("*", "1 AS _k", "2 AS _h", "'x' AS node", "0 AS _pos") if extra else df


def words(r, n, vocab=3000):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def test_packing_keeps_conflicts_apart(spark):
    r = random.Random(4)
    rows = [(i, words(r, r.randrange(1, 60)), r.choice(["hot", "hot", "b", "c", None])) for i in range(300)]
    rows += [(1000 + i, rows[0][1], f"z{i}") for i in range(40)] + [(2000, None, "a"), (2001, "", None), (2002, words(r, 3000), "hot"), (5, rows[5][1], rows[5][2])]
    docs = frame(spark, rows, extra=True)
    got = packing.pack(docs, capacity=128, group_rows=100).toPandas()
    assert (got.groupby(["bin_group", "bin"]).n_units.sum() <= 128).all()
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    size = got.groupby("doc_id").n_units.sum()
    twice = Counter(i for i, *_ in rows)
    assert all(size[i] == twice[i] * -(-len((text[i] or "").encode()) // 4) for i in text)
    for _, b in got.groupby(["bin_group", "bin"]):
        known = [source[i] for i in b.doc_id if source[i] is not None]
        bodies = [text[i] or "" for i in b.doc_id]
        assert len(known) == len(set(known)) and len(bodies) == len(set(bodies))
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10)
    assert [bins.place(6, 1, 0)[0], bins.place(7, 2, 0)[0], bins.place(8, 0, 1)[0]] == [0, 1, 2]
    assert bins.place(2, 0, 1) == (1, 7)  # bin 2 is tighter but holds the cluster
    assert bins.place(2, 1, 0) == (2, 8)
    assert bins.place(4, 1, 0)[0] == 3  # bin 0 fits but holds the source
    r = random.Random(9)
    fast, plain = packing.Bins(50), []
    for _ in range(400):
        n, s, c = r.randrange(51), 1 << r.randrange(4), r.choice([0, 0, 1 << r.randrange(3)])
        b, _ = fast.place(n, s, c)
        fits = [(x[0], k) for k, x in enumerate(plain) if x[0] >= max(n, 1) and not x[1] & s and not x[2] & c]
        if b == len(plain):
            assert not [f for f in fits if n]
            plain.append([50 - n, s, c])
        else:
            assert plain[b][0] == min(fits)[0]
            plain[b] = [plain[b][0] - n, plain[b][1] | s, plain[b][2] | c]


def plain_top(rows, k):
    use = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in use:
        if q % 20 == 0:
            best = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in use if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(50)]
    rows += [(900, None), (920, []), (940, [1.0, None]), (960, [float("nan")] * 8), (980, [float("inf")] * 8), (1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS g", "2 AS score", "3 AS label").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 20)
    few = df.where("vec_id < 5")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 4
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_pruning_changes_nothing():
    rng = np.random.default_rng(3)
    q, d = rng.integers(-60, 60, (20, 16)).astype(float), rng.integers(-60, 60, (3000, 16)).astype(float)
    d[::7] = d[0]
    ids = rng.permutation(3000)
    want = [(i, b, a) for i in range(20) for a, b in sorted(zip(-(d @ q[i]), ids))[:10]]
    for floor in (None, np.array([-[x for j, _, x in want if j == i][-1] for i in range(20)])):
        rows, found, s, _ = topk.search_group(np.arange(20) + 5000, q, ids, d, 10, floor, block=64)
        assert [(i, b, -x) for i, b, x in zip(rows, found, s)] == want
    big = np.full((2, 4), 2.0**28)
    assert topk.search_group(np.array([9]), big[:1], np.array([1, 2]), big, 5)[2].tolist() == [4 * 2**56] * 2
    odd = np.array([[2.0**40, 3.0, -1.0]])
    assert topk.search_group(np.array([9]), odd, np.array([1]), odd, 5)[2].tolist() == [2**80 + 10]


def test_blocks_of_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 32))
    body = np.repeat(centres, 100, axis=0) + rng.normal(0, 0.1, (4000, 32))
    order = rng.permutation(4000)
    q, d = np.floor(64 * body[order[::20]]), np.floor(64 * body)
    floor = topk._floors(order[::20], q, (order[:1000], np.floor(64 * body[order[:1000]])), 5)
    *_, scored = topk.search_group(order[::20], q, np.arange(4000), d, 5, floor, block=50)
    assert scored < 0.15 * len(q) * 80  # more than 85 % of the blocks are left out
    rows = [(i, [float(x) for x in body[i]]) for i in order.tolist()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5)


def test_top_k_of_outliers_and_repeats(spark):
    rows = [(i, [0.5, 1.0 * i, -2.0]) for i in range(60)] + [(61, [1e15, 1.0, 1.0]), (61, [0.25, 0.0, 0.0]), (100, []), (40, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id IN (0, 40)"), k=3).collect()
    # The outlier's scores fit; of the two queries 40 the least one counts.
    assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])) if x["query_id"] == 0][0] == (61, 32 * 64 * 10**15 - 128 * 64)
    assert [(x["rank"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 40] == [(1, 0), (2, 0), (3, 0)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, df.where("vec_id = 61 AND embedding[0] > 1").unionByName(df.where("vec_id = 0").selectExpr("5 AS vec_id", "array(1e17D) AS embedding")), k=3).collect()


def shingles(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(rows):
    """(id -> class, similarities near the threshold)."""
    parent, close = {i: i for i, *_ in rows}, []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s, texts = [(i, shingles(t)) for i, t, _ in rows], [(i, t) for i, t, _ in rows]
    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            same = sum((x & y).values()) / sum((x | y).values()) if x and y else float(rows[a][1] is not None and rows[a][1] == dict(texts)[j])
            close += [same] if 0.77 < same < 0.83 else []
            if same >= 0.8:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}, close


def edited(r, body, n):
    """body with n of its words changed, far from each other."""
    w = body.split()
    for k in range(n):
        w[k * len(w) // max(n, 1) + 2] = f"new{r.randrange(10**9)}"
    return " ".join(w)


def test_near_duplicates(spark):
    r = random.Random(8)
    rows = [(i, words(r, r.randrange(3, 120)), "s") for i in range(60)]
    long = [t for _, t, _ in rows if len(t.split()) > 90]
    for k in range(60, 140):  # copies, near copies (one word of 90 or more: 0.89) and far ones
        body = r.choice(long)
        rows.append((k, r.choice([body, edited(r, body, 1), edited(r, body, 1), " ".join(body.split()[: len(body.split()) // 2])]), "s"))
    rows += [(500, None, "s"), (501, None, "s"), (502, "", "s"), (506, "", "s"), (507, " \n", "s"), (508, " \n", "s"), (503, "one", "s"), (504, "ONE ", "s"), (505, words(r, 20_000), "s")]
    want, close = plain_classes(rows)
    # The weighted similarity differs a little from the plain one, so none may be close to the threshold.
    assert all(s > 0.83 or s < 0.77 for s in close) and len(set(want.values())) < len(rows) - 20
    docs = frame(spark, rows + [(None, rows[0][1], "s")], extra=True)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows) + 1 and [x["class_id"] for x in got if x["doc_id"] is None] == [None]
    assert {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] is not None} == want
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(x["doc_id"] for x in got if x["doc_id"] == x["class_id"] and x["doc_id"] is not None)
    assert neardup.classes(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_in_one_class(spark):
    r = random.Random(2)
    a, b, c = (words(r, 100) for _ in range(3))
    rows = [(7, a, "s"), (7, b, "s"), (9, edited(r, a, 1), "s"), (8, edited(r, b, 1), "s"), (5, c, "s"), (7, a, "s"), (5, None, "s")]
    got = neardup.classes(frame(spark, rows)).collect()
    assert sorted((x["doc_id"], x["class_id"]) for x in got) == [(5, 5), (5, 5), (7, 7), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A group whose members are mostly no links of its centre, in many small blocks."""
    r = random.Random(21)
    base = words(r, 150)
    rows, n = [], 0
    for family in range(12):  # near each other (0.87 or more), about 0.55 from the base
        head = edited(r, base, 10)
        for _ in range(12):
            rows.append((n, edited(r, head + " tail", 1) if r.random() < 0.8 else head, "s"))
            n += 1
    rows += [(n + k, edited(r, base, 20), "s") for k in range(60)]
    want, close = plain_classes(rows)
    assert not close and Counter(Counter(want.values()).values())[12] == 12
    monkeypatch.setattr(neardup, "CHUNK", 16)
    got = neardup.classes(frame(spark, rows)).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want


def test_similarities_both_ways():
    r = random.Random(5)
    texts = [words(r, 60, 12) for _ in range(12)] + ["a b " * 40, "a b " * 30, "", "a"]
    weights = neardup.Weights(np.arange(neardup.DF_BUCKETS) % 97, 1000)
    doc, s, tf = neardup._shingles(next(neardup._blocks(pa.array(texts))))
    left, right = (x.ravel() for x in np.triu_indices(len(texts), 1))
    dense = neardup._similarities(doc, s, tf, weights, len(texts), left, right)
    plain = np.array([neardup.weighted_jaccard(texts[i], texts[j], weights) for i, j in zip(left, right)])
    sparse = np.concatenate([neardup._similarities(doc, s, tf, weights, len(texts), left[k : k + 9], right[k : k + 9]) for k in range(0, len(left), 9)])
    assert np.allclose(dense, plain) and np.allclose(sparse, plain) and (plain > 0.2).any()


def test_samples_agree_as_weights_do():
    r = random.Random(1)
    a = words(r, 400).split()
    b = a[:]
    for k in range(0, 400, 60):
        b[k] = "x"
    weights = neardup.Weights(np.zeros(neardup.DF_BUCKETS), 1000)
    j = neardup.weighted_jaccard(" ".join(a), " ".join(b), weights)
    agree = []
    for n in range(30):  # other words, the same edit
        x = " ".join(f"{w}_{n}" for w in a)
        y = " ".join(f"{w}_{n}" for w in b)
        doc, s, tf = neardup._shingles(next(neardup._blocks(pa.array([x, y]))))
        _, drawn = neardup.draw_samples(doc, s, weights.of(s, tf), 2)
        agree.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(agree) - j) < 0.03


def plain_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    where = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(where[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    r = random.Random(7)
    pool = ["A common line of text", "  a COMMON line of TEXT\t", "short", "ünïcode lïne here", "", "another shared line!", "\x0bodd space line\r", "x" * 5000]
    rows = [(i, "\n".join(r.choice([*pool, words(r, 5)]) for _ in range(r.randrange(1, 150))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n\n", "s"), (103, pool[0], "s"), (3, rows[3][1], "s")]
    docs = frame(spark, rows, extra=True)
    assert sorted(map(tuple, linededup.digest(docs).collect())) == plain_lines(rows)
    cut = linededup.deduplicated(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 100").first()["text"] is None
    with_null = frame(spark, rows + [(None, pool[0], "s")])
    assert linededup.deduplicated(with_null).where("doc_id IS NULL").first()["text"] == pool[0]
    assert linededup.digest(docs.limit(0)).count() == 0


def test_line_dedup_without_hot_keys(spark, monkeypatch):
    rows = [(i, "the very same line\nand line number %d" % i, "s") for i in range(300)]
    docs = frame(spark, rows)
    first = sorted(map(tuple, linededup.digest(docs).collect()))
    monkeypatch.setattr(linededup, "HOT_SHARE", 2.0)
    assert sorted(map(tuple, linededup.digest(docs).collect())) == first == plain_lines(rows)


def plain_repeats(rows):
    seen = Counter(t[p : p + 400] for t in rows for p in range(len(t) - 399))
    out = []
    for t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400 if p + 400 < len(gone) else -1] -= 1
        m = np.cumsum(gone)[:-1] > 0 if len(t) else np.zeros(0, bool)
        kept = bytes(b for b, x in zip(t, m) if not x)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_substrings(spark):
    r = random.Random(12)
    base = words(r, 500)
    texts = []
    for _ in range(40):
        a, n = r.randrange(2000), r.choice([300, 398, 399, 400, 401, 402, 430, 500, 700, 1400])
        texts.append(words(r, r.randrange(60)) + base[a : a + n] + words(r, r.randrange(60)))
    near = list(base)
    near[1500] = "#"
    texts += [base, base, "".join(near), "a" * 1500, "ab" * 400, "é" * 300, "x" * 399, None, "", words(r, 100) * 2, base[:400], "y" * 400]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (None, texts[8], "s")]
    docs = frame(spark, rows, extra=True)
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring.digest(docs).collect())
    want = sorted((-1 if i is None else i, *x) for (i, *_), x in zip(rows, plain_repeats([(t or "").encode() for _, t, _ in rows])))
    assert got == want
    assert substring.digest(docs.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i, "t" * (i % 7), "s") for i in range(997)] + [(5, "again", "s"), (None, None, "s"), (2000, "z" * 200_000, "s")]
    docs = frame(spark, rows, extra=True, parts=7)
    got = sharding.assign(docs, 40, seed=3).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == 1000 and (sizes["count"] == 25).all() and (sizes["min"] == 0).all() and (sizes["max"] == 24).all() and (sizes["nunique"] == 25).all()
    assert got["size"].max() == 200_016 and got["size"].min() == 16 and set(got["law"]) == {"rows"}
    assert sharding.assign(docs.limit(0), 4).count() == 0
    few = sharding.assign(docs.where("doc_id < 3"), 5).toPandas()
    assert len(few) == 3 and few.groupby("shard").size().max() == 1


def test_shards_are_written_in_order(spark, tmp_path):
    rows = [(i, f"text {i}", "s") for i in range(57)] + [(5, "text 5", "s"), (5, "other", "s"), (None, None, "s")]
    docs = frame(spark, rows)
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    assert len(back) == 60 and (back.groupby("shard").size() == 15).all()
    assert Counter(zip(back.doc_id.fillna(-1), back.text.fillna("?"))) == Counter((-1 if i is None else i, "?" if t is None else t) for i, t, _ in rows)
    assert all(sorted(g) == list(range(15)) for _, g in back.groupby("shard").slot)


def test_matrix_is_exact_and_fair():
    ends = np.cumsum([0, 10, 0, 33, 7, 50])
    sizes = sharding.shard_sizes(100, 7)
    total = np.zeros((5, 7))
    for seed in range(300):
        m = np.array([sharding.matrix_row(ends, sizes, p, seed) for p in range(5)])
        assert (m.sum(axis=1) == np.diff(ends)).all() and (m.sum(axis=0) == sizes).all()
        total += m
    assert np.abs(total / 300 - np.outer(np.diff(ends), sizes) / 100).max() < 0.5
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 400) for _ in range(300)]
    assert abs(np.mean(x) - 100) < 3 and 6 < np.std(x) < 12
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5 and sharding.hypergeometric(rng, 0, 2 * 10**9, 5) == 0
    y = [sharding.hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**9) for _ in range(200)]
    assert abs(np.mean(y) - 4 * 10**8) < 5000 and 13_000 < np.std(y) < 18_000


def test_long_near_copies_link(spark):
    r = random.Random(12)
    a = words(r, 60_000, 30_000).split()
    b = ["changed" if k % 1000 == 0 else w for k, w in enumerate(a)]
    a, b, other = " ".join(a), " ".join(b), words(r, 60_000, 30_000)
    assert min(map(len, (a, b, other))) > 300_000
    weights = neardup.Weights(np.zeros(neardup.DF_BUCKETS), 1000)
    assert neardup.weighted_jaccard(a, b, weights) > 0.95 and neardup.weighted_jaccard(a, other, weights) < 0.1
    got = neardup.classes(frame(spark, [(1, a, "s"), (2, b, "s"), (3, other, "s"), (4, "short", "s")])).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_top_k_of_many_tiles(spark, monkeypatch):
    """The k-th score goes from group to group: a tile yields k rows a query at most."""
    rng = np.random.default_rng(9)
    for name, value in (("GROUP", 16), ("QUERY_PACK", 4), ("TILE", 3), ("PACKS", 2), ("SAMPLE", 6), ("CENTRES", 3)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)]) for i in range(500)] + [(600 + i, [0.25] * 12) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    seen = []
    whole = topk.met

    def counted(groups, packs, n_groups, n_packs):
        seen.append((-(-n_groups // 3), n_packs))
        return whole(groups, packs, n_groups, n_packs)

    monkeypatch.setattr(topk, "met", counted)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=4)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 4)
    assert seen[0][0] > 3 and seen[0][1] > 3
    ids, body = np.arange(500), np.floor(64 * np.array([v for _, v in rows[:500]]))
    best = None
    for a in range(0, 500, 100):
        best = topk.search_group(ids[:10], body[:10], ids[a : a + 100], body[a : a + 100], 4, before=best)
        assert np.bincount(best[0]).max() <= 4
    assert best[:3][2].tolist() == topk.search_group(ids[:10], body[:10], ids, body, 4)[2].tolist()
