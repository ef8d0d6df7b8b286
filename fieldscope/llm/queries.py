"""Queries over the driver's tables, one an operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.llm import alignment, bpe_codec, fim, hilbert, language, line_dedup, packing, quality, simhash, token_counts, topk, toxicity, weak_rules
from fieldscope.llm.common import table, vocabulary


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_bpe_codec(spark, sf_dir):
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_sharding(spark, sf_dir):
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op11_fim(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    return alignment.align_corpus(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)


def op13_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_codec, op3_toxicity, op4_quality_classifier, op5_packing, op6_sharding, op7_quality_rules, op8_line_dedup, op9_topk, op10_simhash, op11_fim, op12_alignment, op13_language)}

#: CRC-32 of the bytes of a text, whose table comes from the polynomial's rule; and the places of the cells along the curve.
_CRC = """t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, lang, source, n_chars, CAST(len(bytes) + 8 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]))) AS text_crc32 FROM b, t)"""
_NAME = "coalesce(CAST('0x' || substr(md5({0}), 1, 4) AS INTEGER), 0) % 16"
_SIZE = "CASE WHEN coalesce(n_chars, 0) > 0 THEN least(length(ltrim(bin(n_chars), '0')), 15) ELSE 0 END"
_WHITE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op11_fim": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}') OR contains(text, '{fim.MIDDLE}') AS held FROM u),
p AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS low, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS high, CASE WHEN text = '' OR held OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
x AS (SELECT *, array_to_string(units[1:low], '') AS a, array_to_string(units[low + 1:high], '') AS b, array_to_string(units[high + 1:], '') AS z FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || a || '{fim.SUFFIX}' || z || '{fim.MIDDLE}' || b ELSE '{fim.SUFFIX}' || z || '{fim.PREFIX}' || a || '{fim.MIDDLE}' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM x""",
    "op6_sharding": f"""
WITH {_CRC}, place AS (SELECT {hilbert.curve(3, hilbert.BITS)} AS place),
d AS (SELECT doc_id, size, text_crc32, place[1 + 256 * ({_NAME.format('lang')}) + 16 * ({_NAME.format('source')}) + {_SIZE}] AS cell, coalesce(CAST(doc_id AS VARCHAR), '') || '/' || text_crc32 || '/' || size AS spread FROM c, place),
n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS in_cell, count(*) OVER () AS total FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY cell, CAST('0x' || substr(md5(spread), 1, 8) AS BIGINT) % ((in_cell + {hilbert.BUCKET_ROWS - 1}) // {hilbert.BUCKET_ROWS}), doc_id, text_crc32, size) - 1 AS rank FROM n)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * {hilbert.SHARDS} // total AS INTEGER) AS shard,
    CAST(rank - ((rank * {hilbert.SHARDS} // total) * total + {hilbert.SHARDS - 1}) // {hilbert.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
hosts AS (SELECT source, count(*) AS host_pages FROM d GROUP BY source),
counts AS (SELECT source, line, count(*) AS pages FROM (
    SELECT DISTINCT rid, source, line FROM (SELECT rid, source, unnest(list_transform(lines, lambda x: trim(x, {_WHITE}))) AS line FROM d) WHERE line <> '') GROUP BY source, line),
boiler AS (SELECT c.source, list(c.line) AS drops FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE c.pages >= {line_dedup.LEAST_PAGES} AND c.pages > {line_dedup.RATIO} * h.host_pages GROUP BY c.source),
kept AS (SELECT d.*, CASE WHEN b.drops IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(b.drops, trim(x, {_WHITE}))) END AS k FROM d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(k, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(k), 0) AS BIGINT) AS n_dropped FROM kept""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
