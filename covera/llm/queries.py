"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from covera.llm import (fill_middle, importance, kn_quality, lsh_forest, mixing, mtree, order_minhash, reply_trees,
                        secret_forest, sharding, simhash, token_packing, unigram_pieces)
from covera.llm.common import table


def op1_secret_scan(spark, sf_dir):
    """Every candidate of all documents with the forest's probability of being a secret."""
    return secret_forest.secrets(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    """All documents over 24 shards by proportional stratified interleaving (law: rows)."""
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=24)


def op4_sentencepiece(spark, sf_dir, model: str = "piece_bpe_32k.model"):
    """Unigram pieces of every document, and whether they decode to its text."""
    import public_tokenizers
    pieces = unigram_pieces.read_pieces(public_tokenizers.path(model))
    return unigram_pieces.encode_documents(table(spark, sf_dir, "documents"), pieces)


def op5_mixing(spark, sf_dir):
    """All documents mixed to the source targets by pivotal dependent rounding."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_token_packing(spark, sf_dir, tokenizer: str = "word_bpe_49k.json"):
    """All documents as bit-packed token blocks, read back from the files."""
    import public_tokenizers
    return token_packing.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), end_id=2)


def op7_exact_topk(spark, sf_dir):
    """The 20 best inner products of every vector whose id is divisible by 20, over an M-tree of all vectors."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op8_simhash_dedup(spark, sf_dir):
    """SimHash groups of all documents: three-word shingles, three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, reach=3)


def op9_quality_classifier(spark, sf_dir):
    """Kneser-Ney perplexity of every document against its language's quantile."""
    return kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark, sf_dir):
    """All conversations, and one that is made of control strings, formatted along their best path and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return reply_trees.digests(given.unionByName(extra))


def op11_minhash_dedup(spark, sf_dir):
    """Classes of all documents at Jaccard 0.85 of three-word shingles, candidates from an LSH forest."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op12_fill_middle(spark, sf_dir):
    """All documents cut for filling in the middle, and put together again."""
    return fill_middle.digests(table(spark, sf_dir, "documents"), seed=1)


def op13_importance_resampling(spark, sf_dir):
    """All documents weighed against the benchmark texts by hashed n-grams; 5% drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5,
                               least=20, seed=42)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_order_minhash, op3_sharding, op4_sentencepiece, op5_mixing, op6_token_packing,
    op7_exact_topk, op8_simhash_dedup, op9_quality_classifier, op10_chat_format,
    op11_minhash_dedup, op12_fill_middle, op13_importance_resampling)}

#: The other operators need hashes, tokenizers, drawn numbers or models that SQL does not have;
#: tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op7_exact_topk": """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sizes AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|<unk>|<pad>|<</?SYS>>|\[/?INST\]')) AS body,
    length(role) + len(regexp_extract_all(role, '\\|\n|<\||</?s>|<unk>|<pad>|<</?SYS>>|\[/?INST\]')) AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + body + 24) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id""",
    "op11_minhash_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM docs),
points AS (
  SELECT md5(array_to_string(s, chr(10))) AS p, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS least
  FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT p, n, unnest(s) AS g FROM points),
ordered AS (
  SELECT s.p, s.n, s.g, row_number() OVER (PARTITION BY s.p ORDER BY f.df, s.g) AS r
  FROM shingles s JOIN (SELECT g, count(*) AS df FROM shingles GROUP BY g) f USING (g)),
prefixes AS (SELECT p, n, g FROM ordered WHERE r <= n - (85 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT a.p AS p, b.p AS q FROM prefixes a JOIN prefixes b ON a.g = b.g AND a.p < b.p
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT c.p, c.q FROM candidates c JOIN points a ON a.p = c.p JOIN points b ON b.p = c.q
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 85 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
edges AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach AS (SELECT p, p AS q FROM points UNION SELECT r.p, b.q FROM reach r JOIN edges b ON r.q = b.p),
named AS (SELECT r.p, min(t.least) AS component_id FROM reach r JOIN points t ON t.p = r.q GROUP BY r.p)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE n.component_id END AS component_id,
  s.doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE n.component_id END) AS kept
FROM sets s LEFT JOIN named n ON n.p = md5(array_to_string(s.s, chr(10)))""",
    "op12_fill_middle": """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM given),
cut AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) - least(a, b) AS mid,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
         WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, mid) AS middle, substr(t, lo + mid + 1) AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN mid END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || middle
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts""",
}
