"""The registered queries of this subpackage, with their SQL where SQL can express them.

Every query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, html_render, licenses, line_dedup, minhash_dedup, mixing, quality, ranked_search, resampling, sentencepiece_codec, sharding, substring_dedup
from .common import documents

_CODE_POINT_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz"


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer file; TIDELOG_TOKENIZERS names another folder."""
    folder = os.environ.get("TIDELOG_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), tokenizer_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.NOTICES, wrapped=True).drop("matches")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_render.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir)).drop("spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.with_sizes(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "_text_hash")
    return sharding.shard(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number", "place")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_source_mix": op10_source_mix,
    "op11_bpe": op11_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper_chars,
             length(text) - length(translate(text, '!', '')) AS excl,
             len(list_filter(words, lambda x: lower(trim(x, '.,;:!?')) IN ({_STOPS}))) AS stops
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false
            ELSE n_repeat_words / n_words <= 0.3 AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.15
                 AND upper_chars / word_chars <= 0.4 AND excl / n_words <= 0.4 AND stops / n_words >= 0.03
                 AND n_dup_lines / n_lines <= 0.5 END AS kept
FROM b
"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CODE_POINT_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(node, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r(node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.node = v.vec_id
"""

OP6_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_CODE_POINT_LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN hot.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM late),
e AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
k AS (SELECT e.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN e.word END, ' ' ORDER BY e.p) AS kept
      FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER q - cap AS cap_before, sum(weight) OVER () - sum(weight) OVER q + weight AS weight_left, sum(source_size) OVER () AS total
      FROM w WINDOW q AS (ORDER BY cap::DOUBLE / weight, r ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT min_by((total - cap_before)::DOUBLE / weight_left, (cap::DOUBLE / weight, r)) FILTER ((total - cap_before)::DOUBLE / weight_left * weight < cap) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 1e300) * weight) AS target FROM w, lv),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17/' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN before + size / 2 < target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

#: The checksum is built from its polynomial: a table of 256 entries, then a fold over each distinct word's bytes.
OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CODE_POINT_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_CODE_POINT_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
c0(b, c, k) AS (SELECT b, b::BIGINT, 0 FROM range(256) r(b) UNION ALL
                SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM c0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM c0 WHERE k = 8),
dw AS (SELECT doc_id, unnest(words) AS word FROM d), ew AS (SELECT unnest(words) AS word FROM e),
v AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM ew)),
h AS (SELECT word, xor(list_reduce(list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT),
                                   lambda acc, x: xor(acc // 256, tab[(xor(acc, x) % 256)::INT + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM ew JOIN h USING (word) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM ew) + 10000))))::BIGINT AS gain
      FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)
"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CODE_POINT_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CODE_POINT_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
s AS (SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // all_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY q.item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op10_source_mix": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_ranked_search": OP13_SQL}
