"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, embedding_dedup, jaccard_join, mixing, secrets, sharding, suffix_dedup, token_count, toxicity
from .common import read

#: Production parameters.
WEIGHTS = [1, 2, 3]
SHARD_BYTES = 64 << 20
MODEL = "piece_bpe_32k.model"


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"), WEIGHTS)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.schema))
    return chat.chat_digests(chat.format_chats(turns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as long) AS n_bytes", "shard_depth", "shard_prefix", "shard_bytes", "shard_oversize")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("removed")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size, length(text) AS n, length(regexp_replace(text, '[\p{{L}}\p{{M}}\x20\x09-\x0D]+', '', 'g')) AS other,
    (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (SELECT *, -ln(u) / greatest(0.25, CASE WHEN n > 0 THEN 1.0 - other::DOUBLE / n ELSE 0.0 END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, 1 + rank % 3 AS w, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
ok AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM ok UNION ALL SELECT b, a FROM ok),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\s')"
    for control in chat.CONTROLS:
        mark = "\\l" if control[0] == "<" else "\\b"
        out = f"replace({out}, '{control}', '{mark}{control[1:]}')"
    return out


OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length({_escaped("text")}) + CASE role {" ".join(f"WHEN '{k}' THEN {len(chat.OPEN[k]) + len(chat.CLOSE[k])}" for k in chat.OPEN if k)}
    ELSE {len(chat.OPEN[None]) + len(chat.CLOSE[None]) + 1} + length(replace({_escaped("role")}, chr(10), '\\n')) END AS size FROM t
), c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, {sharding.HASH_BITS // 4}))::BIGINT AS h FROM documents),
k AS (SELECT doc_id, n_bytes, k::INTEGER AS depth, h >> ({sharding.HASH_BITS} - k) AS prefix FROM d, range({sharding.FIRST_BITS + 1}) r(k)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM k GROUP BY 1, 2)
SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, shard_bytes, false AS shard_oversize FROM k JOIN s USING (depth, prefix)
WHERE shard_bytes <= {SHARD_BYTES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the tokenizer, the fitted model, or, at a bearable cost, windows of words and bytes and sliding entropies."""
    return {"op2_source_mix": OP2, "op3_jaccard_join": OP3, "op4_chat_format": OP4, "op6_embedding_dedup": OP6, "op8_shards": OP8}
