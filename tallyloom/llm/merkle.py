"""Merkle manifest of a dataset, with proofs by octopus multiproof.

A leaf is the hash of a row's fields. The leaves of one language, by id, are the lowest level
of a tree in which every two consecutive nodes (the last run may be one) become their hash;
what remains is the language's subroot. The subroots, by language, are the leaves of one more
tree, and what remains of it is the root.

* Leaves are hashed in the JVM and numbered by llm.ranks. Trees are built in runs of 2**BITS
  leaves: a task hashes a run's levels up to one node, and these nodes are the leaves of the
  next pass, so that a tree of n leaves takes log2(n) / BITS passes.
* Proofs are made for any subset of the leaves. Each partition (the wanted leaves of a run)
  finds the least set of nodes that none of its leaves gives: siblings along the paths of all
  its leaves, less what the leaves themselves make. These coordinates meet the manifest in
  one join. The partition then derives the interior nodes that its leaves share, once, and
  expands the proof of each leaf from them.

Hashes are SHA-256; a node hashes the lowercase hexadecimal text of its children, a leaf its
fields, each as `-` if null, else as its UTF-8 byte count, `:` and its value.

Null ids come first, and a null language is a language of its own that comes first. Rows
that repeat an id go by their leaf; equal rows are leaves of their own. An empty table has no
trees, no root and no proofs. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.ranks import ranked
from tallyloom.session import materialize

#: log2 of the leaves of a run.
BITS = 12
#: Key of the tree over the subroots; those of languages begin with l.
TOP = "t"
_NODES = "tree string, level int, idx bigint, hash binary"
PROOF = "array<struct<hash:string,left:boolean>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields of a row, as lowercase hexadecimal text."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def parent(children: list[bytes]) -> bytes:
    """Digest of one or two digests."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


@dataclass
class Manifest:
    leaves: DataFrame  # tree, pos, n, hash and the carried columns
    nodes: DataFrame  # tree, level, idx, hash: all nodes above the leaves
    trees: DataFrame  # tree, subroot, top_pos, top_n: one row a language
    root: str | None
    bits: int


def _grown(level: DataFrame, base: int, bits: int) -> DataFrame:
    """The next `bits` levels of trees whose level `base` is (tree, pos, n, hash)."""

    def run(rows: pa.Table) -> pa.Table:
        by = np.argsort(rows.column("pos").to_numpy())
        at = int(rows.column("pos")[int(by[0])].as_py())
        now = [rows.column("hash")[int(i)].as_py() for i in by]
        tree, n = rows.column("tree")[0].as_py(), rows.column("n")[0].as_py()
        out: list[tuple[int, int, bytes]] = []
        for step in range(1, min(bits, height(n)) + 1):
            now = [parent(now[i : i + 2]) for i in range(0, len(now), 2)]
            out += [(base + step, (at >> step) + i, h) for i, h in enumerate(now)]
        levels, places, hashes = zip(*out, strict=True) if out else ((), (), ())
        return pa.table(
            {"tree": pa.array([tree] * len(out), pa.string()), "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()), "hash": pa.array(hashes, pa.binary())}
        )

    return materialize(level.groupBy("tree", F.shiftright("pos", bits).alias("run")).applyInArrow(run, _NODES), "nodes")


def _built(leaves: DataFrame, bits: int) -> DataFrame:
    """All nodes above the leaves (tree, pos, n, hash)."""
    level, base, parts = leaves.select("tree", "pos", "n", "hash").where("n > 1"), 0, []
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parts.append(_grown(level, base, bits))
        base += bits
        most = -(-most >> bits)
        n = F.shiftright(F.col("n") + ((1 << base) - 1), base)
        sizes = leaves.where("pos = 0").select("tree", n.alias("n"))  # one row a tree
        level = parts[-1].where(F.col("level") == base).select("tree", F.col("idx").alias("pos"), "hash").join(sizes, "tree").where("n > 1")
    if not parts:
        return leaves.sparkSession.createDataFrame([], _NODES)
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, hash: what remains of each tree, the node of the highest level."""
    rows = leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "hash").unionByName(nodes.where("idx = 0").select("tree", "level", "hash"))
    return rows.groupBy("tree").agg(F.max_by("hash", "level").alias("hash"))


def build(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", by: str = "lang", carry: dict[str, Column] | None = None, bits: int = BITS) -> Manifest:
    """The manifest of docs. carry: columns over docs that stay with the leaves."""
    own = {"id": F.col(key), "tree": F.coalesce(F.concat(F.lit("l="), F.col(by)), F.lit("l")), "hash": F.unhex(leaf_hash([F.col(c) for c in columns]))}
    rows = docs.select(*[v.alias(k) for k, v in own.items()], *[v.alias(k) for k, v in (carry or {}).items()])
    leaves = materialize(ranked(rows, "tree", ["id", "hash"], "leaves"), "leaves")
    nodes = _built(leaves, bits)
    # The order of the keys is that of the languages.
    subroots = materialize(ranked(_tops(leaves, nodes).select(F.col("tree").alias("of"), "hash", F.lit(TOP).alias("tree")), "tree", ["of"], "subroots"), "subroots")
    above = _built(subroots, bits)
    root = _tops(subroots, above).first()
    trees = subroots.select(F.col("of").alias("tree"), F.lower(F.hex("hash")).alias("subroot"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"))
    shared = above.unionByName(subroots.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash"))
    return Manifest(leaves, nodes.unionByName(shared), trees, root["hash"].hex() if root else None, bits)


def missing(own: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the nodes that proofs of the leaves at `own`, of a tree
    of n leaves, need and that these leaves don't give."""
    out, known = [], np.unique(own)
    for level in range(height(n)):
        beside = np.setdiff1d(known ^ 1, known)
        out += [(level, int(i)) for i in beside[beside < n]]
        known, n = np.unique(known >> 1), (n + 1) >> 1
    return out


def expanded(own: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes]) -> tuple[list[dict[int, bytes]], list[int]]:
    """Levels below the top of a tree of n leaves, as far as the leaves `own` and the fetched
    nodes make them, each interior node hashed once; and the sizes of these levels."""
    by_level: dict[int, dict[int, bytes]] = {}
    for (level, i), h in fetched.items():
        by_level.setdefault(level, {})[i] = h
    levels, sizes, now = [], [], dict(own)
    for level in range(height(n)):
        now |= by_level.get(level, {})
        levels.append(now)
        sizes.append(n)
        now = {i: parent([now[c] for c in (2 * i, 2 * i + 1) if c < n]) for i in {j >> 1 for j in now}}
        n = (n + 1) >> 1
    return levels, sizes


def path(at: int, levels: list[dict[int, bytes]], sizes: list[int]) -> list[dict]:
    """The proof of the leaf `at`: its siblings, a null where a node is alone in its run."""
    out = []
    for now, n in zip(levels, sizes, strict=True):
        beside = at ^ 1
        out.append({"hash": now[beside].hex() if beside < n else None, "left": beside < at})
        at >>= 1
    return out


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The wanted rows of manifest.leaves (all, if None) without tree, pos and n, with hash as
    text and subroot, root and `proof`, the siblings level by level from leaf to root."""
    leaves = manifest.leaves if wanted is None else wanted
    leaves = leaves.join(manifest.trees, "tree").withColumn("run", F.shiftright("pos", manifest.bits))

    def needs(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        found = [(first["tree"], *x) for x in missing(rows.column("pos").to_numpy(), first["n"])]
        found += [(TOP, *x) for x in missing(np.array([first["top_pos"]]), first["top_n"])]
        k = len(found)
        of, level, idx = zip(*found, strict=True) if found else ((), (), ())
        return pa.table(
            {
                "tree": pa.array([first["tree"]] * k, pa.string()), "run": pa.array([first["run"]] * k, pa.int64()),
                "of": pa.array(of, pa.string()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()),
            }
        )

    asked = leaves.select("tree", "run", "pos", "n", "top_pos", "top_n").groupBy("tree", "run").applyInArrow(needs, "tree string, run bigint, of string, level int, idx bigint")
    asked = materialize(asked, "asked")
    # Nodes of the levels asked for; with whole runs that leaves out all those inside of runs.
    least = asked.where(F.col("of") != TOP).agg(F.min("level")).first()[0]
    stored = manifest.nodes.where((F.col("tree") == TOP) | (F.col("level") >= (1 if least is None else least)))
    if least == 0:
        stored = stored.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash"))
    fetched = asked.join(stored.withColumnRenamed("tree", "of"), ["of", "level", "idx"]).select("tree", "run", "of", "level", "idx", "hash")

    drop = ("tree", "pos", "n", "run", "top_pos", "top_n")
    fields = [f for f in leaves.schema if f.name not in (*drop, "hash")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["hash string", f"proof {PROOF}"])
    proof_type = pa.list_(pa.struct([("hash", pa.string()), ("left", pa.bool_())]))

    def expand(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0] if rows.num_rows else None
        at = rows.column("pos").to_pylist()
        own = dict(zip(at, rows.column("hash").to_pylist(), strict=True))
        got = {(of, level, i): h for of, level, i, h in zip(*(nodes.column(c).to_pylist() for c in ("of", "level", "idx", "hash")), strict=True)}
        proofs: list[list[dict]] = []
        if first is not None:
            levels, sizes = expanded(own, first["n"], {k[1:]: h for k, h in got.items() if k[0] != TOP})
            above = expanded({first["top_pos"]: bytes.fromhex(first["subroot"])}, first["top_n"], {k[1:]: h for k, h in got.items() if k[0] == TOP})
            rest = path(first["top_pos"], *above)
            proofs = [path(i, levels, sizes) + rest for i in at]
        columns = {f.name: rows.column(f.name) for f in fields}
        columns["hash"] = pa.array([own[i].hex() for i in at], pa.string())
        columns["proof"] = pa.array(proofs, proof_type)
        return pa.table(columns)

    out = leaves.groupBy("tree", "run").cogroup(fetched.groupBy("tree", "run")).applyInArrow(expand, schema)
    return out.withColumn("root", F.lit(manifest.root).cast("string"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash (as text) and a proof give."""

    def step(now: Column, s: Column) -> Column:
        pair = F.when(s["hash"].isNull(), now).when(s["left"], F.concat(s["hash"], now)).otherwise(F.concat(now, s["hash"]))
        return F.sha2(pair, 256)

    return F.aggregate(proof, leaf, step)


def proof_hash(proof: Column) -> Column:
    """Hash of a proof's siblings, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["hash"]), ""), 256)
