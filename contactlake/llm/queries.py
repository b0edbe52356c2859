"""Registered queries of the training-data operators, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm import bytebpe, gif, jaccard, language, merkle, mixing, negatives, neighbours, packing, quality, shards, tokens, toxicity
from contactlake.llm.tables import read

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SHARDS = 24
QUALITY_FROM = 0.3
TOXIC_FROM = 0.7
QUERY_EVERY = 20
TAMPERED_EVERY = 7
ANCHOR_EVERY = 100
MOVED_EVERY = 7
LABELS = 10
RANKS = "byte_bpe_50k.tiktoken"


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).drop("set_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_scores(read(spark, sf_dir, "documents"), pooled_below=1)


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(read(spark, sf_dir, "documents"), keep_media=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=QUALITY_FROM)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, sf_dir, "embeddings"), QUERY_EVERY)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT, end_id=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=TOXIC_FROM)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.balanced_shards(read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    out = merkle.document_manifest(read(spark, sf_dir, "documents"), tampered)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    folded = merkle.fold(F.col("told_leaf"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                      folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), ANCHOR_EVERY, relabel=moved)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    out = bytebpe.decode(bytebpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard, op2_language, op3_gif, op4_quality, op5_neighbours, op6_token_counts, op7_packing,
                            op8_toxicity, op9_shards, op10_mixing, op11_merkle,
                            op12_negatives, op13_byte_bpe)}

# Only near copies can be said in SQL: the others rest on hashes, models or tokenizers it lacks.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {"op1_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT ways.y, r FROM reach JOIN ways ON ways.x = reach.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(reach.r), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op11_merkle": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text FROM documents),
f AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b:
      list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT), 4294967295) % 7 = 0 AS bad
  FROM d),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) AS other, bad
  FROM f),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM h)),
leaves AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
    doc_id, leaf, CASE WHEN bad THEN other ELSE leaf END AS told
  FROM h JOIN langs ON h.lang IS NOT DISTINCT FROM langs.lang),
low AS (
  SELECT g, 0 AS level, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY g, level, pos // 2, n),
tops AS (SELECT g, level, hash AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS pos, (SELECT count(*) FROM tops) AS n, subroot AS hash FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1
  GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.g, l.pos AS leaf_pos, s.level, s.hash, s.pos > l.pos >> s.level AS behind
  FROM leaves l JOIN low s ON s.g = l.g AND s.n > 1 AND s.pos = xor(l.pos >> s.level, 1)
  UNION ALL
  SELECT l.g, l.pos, t.level + s.level, s.hash, s.pos > l.g >> s.level
  FROM leaves l JOIN tops t ON t.g = l.g JOIN high s ON s.n > 1 AND s.pos = xor(l.g >> s.level, 1)),
walk AS (
  SELECT g, pos, 0 AS level, told AS hash FROM leaves
  UNION ALL
  SELECT w.g, w.pos, w.level + 1,
    sha256(CASE WHEN s.hash IS NULL THEN w.hash WHEN s.behind THEN w.hash || s.hash ELSE s.hash || w.hash END)
  FROM walk w JOIN tops t ON t.g = w.g LEFT JOIN steps s ON s.g = w.g AND s.leaf_pos = w.pos AND s.level = w.level
  WHERE w.level < t.level + (SELECT max(level) FROM high)),
ends AS (SELECT g, pos, max_by(hash, level) AS folded_root FROM walk GROUP BY g, pos),
proofs AS (SELECT g, leaf_pos, sha256(string_agg(hash, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, t.subroot, r.hash AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = r.hash AS verified
FROM leaves l JOIN tops t ON t.g = l.g JOIN ends e ON e.g = l.g AND e.pos = l.pos
LEFT JOIN proofs p ON p.g = l.g AND p.leaf_pos = l.pos CROSS JOIN (SELECT hash FROM high WHERE n = 1) r""",
    "op12_negatives": """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id % 100 = 0),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT n.anchor_id, positive_id, row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""}
