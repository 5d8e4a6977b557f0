"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm import bpe

    return bpe.round_trip_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP3_SQL = """
WITH z AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM z WHERE vec_id % 20 = 0),
s AS (
  SELECT query_id, vec_id, CAST(coalesce(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM q JOIN z ON vec_id <> query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn_patterns(docs))


SHARDS = 40


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import sharding

    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 3) = 1"


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.expr(f"NOT ({HELD_OUT})")))
    found = langid.predict(docs, model)
    # A null id is neither held out nor learned from.
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import linededup

    return linededup.digest(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, ls[i] AS line,
    translate(regexp_replace(regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)),
marked AS (
  SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.first_doc AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substring

    return substring.digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import merkle

    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    longer = merkle.leaf_hash([*fields, F.col("n_chars") + 1, F.col("text")])
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, longer)
    proofs = merkle.prove(merkle.build(docs, carry={"tampered": tampered}))
    out = proofs.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "hash"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE x AS (
  SELECT doc_id, lang, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
    n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc
  FROM documents),
f AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered FROM x),
base AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM base
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
who AS (SELECT base.*, row_number() OVER () AS r, subroot, subs.pos AS top_pos FROM base JOIN subs ON base.lang IS NOT DISTINCT FROM subs.lang),
step AS (
  SELECT r, 0 AS stage, t.level, t.n, xor(w.pos >> t.level, 1) < (w.pos >> t.level) AS on_left, s.h
  FROM who w JOIN (SELECT DISTINCT lang, level, n FROM tree WHERE n > 1) t ON w.lang IS NOT DISTINCT FROM t.lang
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = t.level AND s.pos = xor(w.pos >> t.level, 1)
  UNION ALL
  SELECT r, 1, t.level, t.n, xor(w.top_pos >> t.level, 1) < (w.top_pos >> t.level), s.h
  FROM who w CROSS JOIN (SELECT DISTINCT level, n FROM top WHERE n > 1) t LEFT JOIN top s ON s.level = t.level AND s.pos = xor(w.top_pos >> t.level, 1)),
proof AS (
  SELECT r, coalesce(string_agg(h, '' ORDER BY stage, level), '') AS said, list({'h': h, 'on_left': on_left} ORDER BY stage, level) AS steps FROM step GROUP BY r),
fold AS (
  SELECT w.r, 1 AS k, coalesce(tampered, leaf) AS h, steps FROM who w LEFT JOIN proof USING (r)
  UNION ALL
  SELECT r, k + 1, sha256(CASE WHEN steps[k].h IS NULL THEN h WHEN steps[k].on_left THEN steps[k].h || h ELSE h || steps[k].h END), steps FROM fold WHERE k <= len(steps)),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(said, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM who LEFT JOIN proof USING (r) JOIN fold ON fold.r = who.r AND fold.k = coalesce(len(fold.steps), 0) + 1 CROSS JOIN root
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH z AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, z.vec_id, a.label = z.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, z.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM z a JOIN z ON z.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""


def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm import histopack

    found = histopack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_personal_data": op5_personal_data,
        "op6_sharding": op6_sharding,
        "op7_language_id": op7_language_id,
        "op8_line_dedup": op8_line_dedup,
        "op9_repeated_substrings": op9_repeated_substrings,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_histogram_packing": op13_histogram_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op8_line_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL}
