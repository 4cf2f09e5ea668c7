"""The registered queries of the training-data operators, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, learned_partitions, merkle_manifest, mixing, packing, parity_join, quality_mil, recurrent_lm, secret_scan, substring_dedup, threshold_topk, toxicity, url_rules
from .common import ascii_lower, crc32_mod, table

#: The rules of op8, the longest fitting one wins.
URL_RULES = [
    url_rules.Rule("block", "net", "/"),
    url_rules.Rule("allow", "example.net", "/en/"),
    url_rules.Rule("block", "example.com", "/de/"),
    url_rules.Rule("allow", "org", "/fr/"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("digest")


def op2_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0, k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = model.score(docs)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0, k=20)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = recurrent_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    leaf = lambda text: merkle_manifest.digest(*map(merkle_manifest.field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))
    claimed = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("digest"), leaf(claimed).alias("claimed"))
    found = merkle_manifest.manifest(leaves, arity=16).withColumn("folded_root", merkle_manifest.folded(F.col("claimed"), F.col("path")))
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle_manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    scored = quality_mil.fit(docs, table(spark, sf_dir, "labels"), ~held_out).score(docs)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.spliced(turns, block=20, most=4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_parity_jaccard,
        op3_source_mixing,
        op4_threshold_topk,
        op5_secret_scan,
        op6_toxicity,
        op7_learned_partitions,
        op8_url_rules,
        op9_best_fit_packing,
        op10_recurrent_lm,
        op11_merkle_manifest,
        op12_quality_mil,
        op13_conversation_trie,
    )
}

def _crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the decimal digits of a value."""
    octets = f"list_transform(range(1, length(CAST({value} AS VARCHAR)) + 1), lambda i: ascii(substr(CAST({value} AS VARCHAR), i, 1)))"
    step = "list_reduce([xor(crc, octet), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda crc, octet: {step}), 4294967295)"


def _leaf_sql(text: str) -> str:
    part = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents WHERE text IS NOT NULL
        ), lo AS (
          SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l
        ), m AS (
          SELECT doc_id, i, base, regexp_replace(line, '([.!?])([ \t])', '\1' || chr(1) || '\2', 'g') AS m FROM lo
        ), p AS (
          SELECT doc_id, i, base, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS j FROM m
        ), po AS (
          SELECT *, base + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p
        ), u AS (
          SELECT doc_id, CAST(pos + length(regexp_extract(piece, '^[\x20\x09-\x0D]*', 0)) AS BIGINT) AS start,
            CAST(pos + length(regexp_replace(piece, '[\x20\x09-\x0D]+$', '')) AS BIGINT) AS "end",
            list_filter(string_split_regex(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
          FROM po
        ), r AS (
          SELECT doc_id, start, "end", array_to_string(words, ' ') AS norm, len(words) AS words,
            row_number() OVER (PARTITION BY doc_id ORDER BY start) AS place
          FROM u WHERE len(words) > 0
        ), k AS (
          SELECT doc_id, start, "end", words, place, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start, count(*) OVER (PARTITION BY norm) AS copies
          FROM r WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start)
        ), a AS (
          SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM k WHERE doc_id <> kept_doc_id OR start <> kept_start
        ), s AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id, run) AS BIGINT) AS run_words FROM a)
        SELECT doc_id, start, "end", kept_doc_id, kept_start, copies, run_words FROM s WHERE run_words >= 20
    """,
    "op2_parity_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
          FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
          FROM w
        ), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM s
          UNION
          SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
        )
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
        FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, s.shingles
    """,
    "op4_threshold_topk": """
        WITH q AS (
          SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          GROUP BY vec_id
        ), scored AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
          FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        ), ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op8_url_rules": r"""
        WITH u AS (
          SELECT page_id,
            CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) END AS rest
          FROM pages
        ), p AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '/[^\n]*(\n[^\n]*)*$', 0) AS path
          FROM u
        ), m AS (
          SELECT page_id, host, path,
            CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM p
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE l AS (
          SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf_sql('text')} AS leaf,
            {_leaf_sql("CASE WHEN " + _crc32_sql('doc_id') + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS claimed
          FROM documents
        ), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
        n AS (
          SELECT g, 0 AS level, rank AS i, leaf AS digest FROM r
          UNION ALL
          SELECT g, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM n) WHERE many > 1 GROUP BY g, level, i // 16
        ), s AS (
          SELECT g, arg_max(digest, level) AS subroot, max(level) AS top, row_number() OVER (ORDER BY g) - 1 AS rank FROM n GROUP BY g
        ), m AS (
          SELECT 0 AS level, rank AS i, subroot AS digest FROM s
          UNION ALL
          SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS many FROM m) WHERE many > 1 GROUP BY level, i // 16
        ), steps AS (
          SELECT r.g, r.rank, n.level AS step, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < r.rank // CAST(16 ** n.level AS BIGINT)), '') AS lefts,
            coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > r.rank // CAST(16 ** n.level AS BIGINT)), '') AS rights
          FROM r JOIN s USING (g) JOIN n ON n.g = r.g AND n.level < s.top AND n.i // 16 = r.rank // CAST(16 ** (n.level + 1) AS BIGINT) GROUP BY r.g, r.rank, n.level
          UNION ALL
          SELECT r.g, r.rank, 1000 + m.level, coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (m.i < s.rank // CAST(16 ** m.level AS BIGINT)), ''),
            coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (m.i > s.rank // CAST(16 ** m.level AS BIGINT)), '')
          FROM r JOIN s USING (g) JOIN m ON m.level < (SELECT max(level) FROM m) AND m.i // 16 = s.rank // CAST(16 ** (m.level + 1) AS BIGINT) GROUP BY r.g, r.rank, m.level
        ), p AS (SELECT g, rank, list({{'l': lefts, 'r': rights}} ORDER BY step) AS path FROM steps GROUP BY g, rank),
        t AS (SELECT arg_max(digest, level) AS root FROM m),
        f AS (
          SELECT r.*, subroot, root, coalesce(list_aggregate(list_transform(path, lambda x: x.l || x.r), 'string_agg', ''), '') AS proof,
            list_reduce(list_concat([{{'l': claimed, 'r': ''}}], coalesce(path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded
          FROM r JOIN s USING (g) CROSS JOIN t LEFT JOIN p ON p.g = r.g AND p.rank = r.rank
        )
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f
    """,
    "op13_conversation_trie": rf"""
        WITH o AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS depth
          FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {_crc32_sql('conv_id')} % 4 AS h, max(depth) AS have FROM o GROUP BY conv_id),
        k AS (SELECT c.*, least(c.h, coalesce(q.have, 0)) AS taken FROM c LEFT JOIN c AS q ON q.conv_id = c.head),
        t AS (
          SELECT k.conv_id, o.depth, role, text FROM k JOIN o ON o.conv_id = k.head AND o.depth <= k.taken
          UNION ALL
          SELECT k.conv_id, o.depth - k.h + k.taken, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND o.depth > k.h
        ), len AS (SELECT conv_id, taken + greatest(have - h, 0) AS len FROM k),
        w AS (
          SELECT conv_id, depth, list((role, text)) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
            len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM t
          UNION ALL
          SELECT conv_id, 0, [], 0 FROM len
        ), m AS (SELECT w.*, min(conv_id) OVER (PARTITION BY prefix) AS node, w.depth = len.len AS ends FROM w JOIN len USING (conv_id)),
        n AS (
          SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM m GROUP BY node, depth
        ), up AS (SELECT DISTINCT a.node, a.depth, b.node AS above, b.depth AS above_depth FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth <= a.depth),
        kids AS (SELECT above AS node, above_depth AS depth, count(*) AS children FROM up WHERE depth = above_depth + 1 GROUP BY ALL),
        sums AS (
          SELECT up.above AS node, up.above_depth AS depth, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
          FROM up JOIN n ON n.node = up.node AND n.depth = up.depth LEFT JOIN kids ON kids.node = up.node AND kids.depth = up.depth GROUP BY ALL
        )
        SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, up.above AS parent_conv_id, n.n_convs, CAST(coalesce(children, 0) AS BIGINT) AS n_children,
          n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM n JOIN sums ON sums.node = n.node AND sums.depth = n.depth LEFT JOIN kids ON kids.node = n.node AND kids.depth = n.depth
        LEFT JOIN up ON up.node = n.node AND up.depth = n.depth AND up.above_depth = n.depth - 1
    """,
}
