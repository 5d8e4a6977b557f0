"""Manifest, hard negatives and histogram packing against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tallyloom.llm import histopack, merkle, negatives  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(now, at):
    """(top, siblings of the node at `at`, level by level) of a tree over `now`."""
    beside = []
    while len(now) > 1:
        if at ^ 1 < len(now):
            beside.append(now[at ^ 1])
        now, at = [sha(*now[i : i + 2]) for i in range(0, len(now), 2)], at >> 1
    return now[0], beside


def documents():
    r = random.Random(7)
    rows = [(i, f"text {i} é" * r.randrange(4), r.choice(["en", "en", "en", "de", None]), r.choice(["a", None]), r.choice([3, 10**12, None])) for i in range(150)]
    rows += [rows[3]] * 40 + [(3, "other", rows[3][2], None, 1), (None, None, None, None, None), (None, "", "en", "", 0), (9_000, None, "fr", "x", 1), (9_001, "x" * 300_000, "", "y", -4)]
    return rows


def test_manifest_equals_trees_by_hand(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 AS pos", "2 AS n", "'t' AS tree", "'h' AS hash", "0 AS _at", "1 AS id", "2 AS run", "3 AS proof")
    trees = defaultdict(list)
    for d, text, lang, source, n in rows:
        trees[lang].append(((d is not None, d or 0), sha(*map(field, (d, source, lang, n, text)))))
    order = sorted(trees, key=lambda x: (x is not None, x or ""))
    leaves = {k: [h for _, h in sorted(v)] for k, v in trees.items()}
    subroots = [climb(leaves[k], 0)[0] for k in order]
    root = climb(subroots, 0)[0]
    want = []
    for k, lang in enumerate(order):
        for at, h in enumerate(leaves[lang]):
            want.append((h, subroots[k], root, sha(*climb(leaves[lang], at)[1], *climb(subroots, k)[1])))
    changed = F.when(F.col("doc_id") % 7 == 0, merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]))
    for bits in (2, merkle.BITS):
        manifest = merkle.build(docs, carry={"changed": changed}, bits=bits)
        assert manifest.root == root
        proofs = merkle.prove(manifest).withColumn("said", merkle.proof_hash(F.col("proof"))).withColumn("up", merkle.folded(F.col("hash"), F.col("proof")))
        proofs = proofs.withColumn("tampered", merkle.folded(F.coalesce("changed", "hash"), F.col("proof")))
        got = proofs.collect()
        assert sorted((x["hash"], x["subroot"], x["root"], x["said"]) for x in got) == sorted(want)
        assert all(x["up"] == root for x in got)
        assert all((x["tampered"] == root) == (x["changed"] is None or x["changed"] == x["hash"]) for x in got)
        # A subset: the same proofs, from nodes that the subset lacks.
        some = merkle.prove(manifest, manifest.leaves.where("id IN (3, 9000) OR id % 31 = 0")).withColumn("said", merkle.proof_hash(F.col("proof")))
        whole = {(x["id"], x["hash"], x["said"]) for x in got}
        few = [(x["id"], x["hash"], x["said"]) for x in some.collect()]
        assert set(few) <= whole and len(few) == 40 + 1 + 1 + len({i for i in range(150) if i % 31 == 0 or i == 3})
    none = merkle.build(docs.limit(0))
    assert none.root is None and merkle.prove(none).count() == 0


def test_multiproof_is_least():
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(1, 40)
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([merkle.parent(levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        own = sorted(r.sample(range(n), r.randrange(1, n + 1)))
        asked = merkle.missing(np.array(own), n)
        assert len(asked) == len(set(asked))
        held, sizes = merkle.expanded({i: leaves[i] for i in own}, n, {(v, i): levels[v][i] for v, i in asked})
        assert all(h == levels[v][i] for v, some in enumerate(held) for i, h in some.items())
        for i in own:
            assert [s["hash"] for s in merkle.path(i, held, sizes)] == [levels[v][(i >> v) ^ 1].hex() if (i >> v) ^ 1 < sizes[v] else None for v in range(len(sizes))]
        # None of them can be made from the leaves that are there.
        made = {(v, i >> v) for i in own for v in range(len(levels))}
        assert not made & set(asked)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def mined(rows, anchors, n_positives=5, n_negatives=10):
    """By hand; rows are (id, vector, label)."""
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = {}
    for i, v, c in sorted(fine, key=lambda x: (x[2], x[1])):
        first.setdefault(i, (v, c))
    out = []
    for a in anchors:
        if a not in first:
            continue
        v, c = first[a]
        scored = sorted(((-dot(v, w), i, d) for i, w, d in fine if i != a))
        for s, p, _ in [x for x in scored if x[2] == c][:n_positives]:
            hard = [x for x in scored if x[2] != c and 3 * -s <= 10 * -x[0] <= 9 * -s][:n_negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(hard)]
    return sorted(out)


def clustered(r, n, dims, clusters=6):
    centres = r.normal(size=(clusters, dims))
    return [list(map(float, (centres[k % clusters] + 0.25 * r.normal(size=dims)).astype(np.float32))) for k in range(n)]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(k, v, int(r.integers(0, 4))) for k, v in enumerate(clustered(r, 260, 24))]
    rows += [(1000 + k, rows[7][1], k % 3) for k in range(60)]  # copies: ties
    rows += [(5, rows[5][1], rows[5][2]), (20, rows[21][1], 1), (2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 24, 0), (2003, rows[1][1], None), (None, rows[1][1], 0), (2004, [], 0), (2005, [0.5] * 70, 2), (2006, [0.0] * 24, 3)]
    table = spark.createDataFrame(rows, VECTORS).repartition(4).selectExpr("*", "1 AS k", "2 AS v", "3 AS pack", "'b' AS bucket")
    for name, value in (("GROUP", 32), ("TILE", 2), ("ANCHORS", 8), ("PACKS", 2)):
        monkeypatch.setattr(negatives, name, value)
    asked = table.where("vec_id % 10 = 0 OR vec_id IN (5, 2004)")
    got = sorted(map(tuple, negatives.mine(table, asked).collect()))
    want = mined(rows, sorted({i for i, *_ in rows if i is not None and (i % 10 == 0 or i in (5, 2004))}))
    # Where rows repeat an id and a score, a positive can come twice.
    assert got == want and len(got) > 500
    assert negatives.mine(table.limit(0), asked.limit(0)).count() == 0
    assert negatives.mine(table, asked.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], VECTORS)
    assert negatives.mine(one, one).count() == 0


def test_large_values_are_exact(spark):
    rows = [(0, [2.0**30, 1.0], 0), (1, [2.0**15, 3.0], 0), (2, [2.0**14, 5.0], 1), (3, [2.0**14, 5.5], 1), (4, [2.0**13, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mine(table, table.where("vec_id = 0")).collect())) == mined(rows, [0])


def test_intervals_hold_and_drop():
    r = np.random.default_rng(8)
    for dims, scale in ((3, 1.0), (64, 100.0), (300, 1e6)):
        q, d = np.floor(scale * r.normal(size=(20, dims))), np.floor(scale * r.normal(size=(200, dims)))
        width = negatives.code_width(dims)
        turned = negatives.rotated(d, width)
        assert np.allclose((turned**2).sum(axis=1), (d**2).sum(axis=1))
        least, most = negatives.intervals(q, negatives.encode(d, width), width)
        s = q @ d.T
        assert (least <= s).all() and (s <= most).all()
    # Vectors in clusters: most rows are never scored.
    mat = np.floor(256 * np.array(clustered(r, 4000, 128, 40)))
    group = lambda ids: negatives.Group(ids, ids % 2, mat[ids], negatives.encode(mat[ids], 128))
    q = group(np.arange(0, 4000, 100))
    _, scored = negatives.closest(q, iter([group(np.arange(a, a + 500)) for a in range(0, 4000, 500)]), 5, 128)
    assert scored < 0.15 * 40 * 4000


def test_plan_places_every_piece_once():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([8, 16, 64])
        histogram = {n: r.randrange(30) for n in range(1, capacity + 1) if r.random() < 0.4}
        pieces, packs = defaultdict(list), defaultdict(list)
        for x in histopack.plan(histogram, capacity):
            for k in range(x.first, x.last):
                pieces[x.length, k].append((x.start, x.size))
                packs[x.sequence + k - x.first].append((x.offset, x.size))
        assert set(pieces) == {(n, k) for n, c in histogram.items() for k in range(c)}
        for parts, total in [*((v, n) for (n, _), v in pieces.items()), *((v, None) for v in packs.values())]:
            at = 0
            for a, m in sorted(parts):
                assert a == at and m > 0
                at += m
            assert at == total if total else at <= capacity
        assert sorted(packs) == list(range(-(-sum(n * c for n, c in histogram.items()) // capacity)))
    # Lengths that can't share a pack are cut; a million of each is as few runs as one.
    assert len(histopack.plan({700: 10**9, 13: 10**9 + 1, 1024: 5})) < 2000


def test_shortest_pack_comes_first():
    where = {(x.length, x.first): (x.sequence, x.offset) for x in histopack.plan({7: 1, 6: 1, 2: 1, 1: 1}, 8)}
    assert where[6, 0][0] == where[2, 0][0] and where[7, 0][0] == where[1, 0][0]


def test_histogram_packing_equals_the_tokenizer(spark):
    r = random.Random(2)
    texts = [None, "", "  a  b\n\n\n c", "<|endoftext|> x", "é́ \U0001f600'll don't\t\t \r\n x", " " * 3000, "a" * 5000]
    texts += [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(900))) for _ in range(60)] + ["again and again"] * 30
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS part", "2 AS at", "3 AS ids", "4 AS _rank", "5 AS length", "6 AS start")
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = histopack.pack(docs, path, public_tokenizers.PATTERN)
    got = packed.withColumn("crc", F.crc32("ids")).collect()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate([t for _, t, *_ in rows])}
    assert sum(x["length"] for x in got) == sum(map(len, ids.values()))
    lone = {i: k for k, (i, *_) in enumerate(rows) if i is not None and i != 1}
    of = defaultdict(list)
    for x in got:
        of[x["doc_id"]].append(x)
    for i, k in lone.items():
        at = 0
        for x in sorted(of[i], key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids[k]) and x["crc"] == zlib.crc32(ids[k][at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids[k])
    whole = {x["sequence_id"]: x for x in histopack.sequences(packed).collect()}
    total = sum(map(len, ids.values()))
    assert len(whole) == -(-total // 1024) and sum(x["padded"] for x in whole.values()) - total < 1024
    for x in got:
        assert whole[x["sequence_id"]]["ids"][4 * x["offset"] : 4 * (x["offset"] + x["length"])] == x["ids"]
    assert all(len(x["ids"]) == 4 * x["used"] <= 4096 for x in whole.values())
    assert histopack.pack(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
