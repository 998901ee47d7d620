"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_codec, decontamination, embedding_dedup, license_scan, line_rules, merkle_manifest, minhash_dedup, packing, spelling_variants, substring_dedup, suffix_dedup, token_counts, token_files
from millrace.llm.catalog import query
from millrace.llm.common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_bpe_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest_documents(documents(spark, sf_dir), WORD_BPE)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir), window=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(documents(spark, sf_dir), WORD_BPE, end_id=2)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), PIECE_BPE)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE, capacity=2048)


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


@query("op9_minhash_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


LINE_RULES_SQL = r"""
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS o, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t
           FROM {table}),
w AS (SELECT o, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, t, doc_id, host FROM d),
place AS (SELECT o, words, unnest(range(1, len(words) - 6)) AS p FROM w),
win AS (SELECT o, p, array_to_string(words[p:p + 7], ' ') AS g FROM place),
rep AS (SELECT o, p FROM (SELECT o, p, count(*) OVER (PARTITION BY o, g) AS n FROM win) WHERE n > 1),
gaps AS (SELECT o, p, lead(p) OVER (PARTITION BY o ORDER BY p) - p AS gap FROM rep),
covered AS (SELECT o, sum(least(8, coalesce(gap, 8))) AS n_repeat_words FROM gaps GROUP BY o),
raw_lines AS (SELECT o, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT o, count(*) - count(DISTINCT l) AS n_dup_lines FROM raw_lines
        WHERE translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '' GROUP BY o),
lines AS (SELECT o, host, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS l
          FROM raw_lines JOIN d USING (o)),
full_lines AS (SELECT o, host, l, len(string_split(l, ' ')) AS n FROM lines WHERE l <> ''),
counts AS (SELECT host, l, count(DISTINCT o) AS n, min(o) AS first FROM full_lines GROUP BY host, l),
often AS (SELECT host, l, first FROM counts WHERE n > 10),
gone AS (SELECT f.o, sum(f.n) AS gone FROM full_lines f JOIN often x ON f.host = x.host AND f.l = x.l AND f.o <> x.first GROUP BY f.o),
stats AS (
  SELECT w.o, w.doc_id, len(words) AS n_words,
         length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM w LEFT JOIN dup USING (o) LEFT JOIN covered USING (o) LEFT JOIN gone USING (o)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, least(gone, n_words) AS n_line_words FROM stats)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       n_line_words::BIGINT AS n_line_words,
       NOT base_failed AND NOT (n_words - n_line_words < n_words * 0.2) AS kept
FROM judged
"""


@query("op10_line_rules", LINE_RULES_SQL.replace("{table}", "documents"))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.quality_rules(documents(spark, sf_dir), limit_documents=10)
    return out.drop("text", "lang", "source", "n_chars", "kept_text")


HITS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
cut AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM cut),
sizes AS (SELECT DISTINCT m FROM phrases),
places AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT r, p, m, item FROM (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM places) JOIN phrases USING (m, g)),
hit_words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS x FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
""".replace(
    "{words}",
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')",
)


@query("op11_benchmark_decontamination", HITS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    contaminated = (F.col("n_hit") > 0).alias("contaminated")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated)


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes: a byte is taken in, then shifted out bit by bit."""
    code = f"hex(encode({value}))"
    byte = f"list_transform(range(length({code}) // 2), lambda k: ('0x' || substr({code}, (2 * k + 1)::INT, 2))::BIGINT + 256)"
    steps = f"flatten(list_transform({byte}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN x >= 256 THEN xor(c, x - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295)"


MERKLE_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN flagged AND text IS NOT NULL
              THEN sha256(head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) END AS found
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
               {crc} % 2 = 0 AS flagged FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS i FROM leaves),
inner_tree AS (
  SELECT source, 0 AS lvl, i, leaf AS h FROM placed
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM inner_tree) WHERE n > 1 GROUP BY source, lvl, i // 3),
tops AS (SELECT source, max(lvl) AS high, max_by(h, lvl) AS subroot FROM inner_tree GROUP BY source),
seated AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tops),
outer_tree AS (
  SELECT 0 AS lvl, i, subroot AS h FROM seated
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM outer_tree) WHERE n > 1 GROUP BY lvl, i // 3),
top AS (SELECT max(lvl) AS high, max_by(h, lvl) AS root FROM outer_tree),
lower_walk AS (
  SELECT r, source, 0 AS lvl, i, coalesce(found, leaf) AS here, '' AS proof FROM placed
  UNION ALL
  SELECT w.r, w.source, w.lvl + 1, w.i // 3, sha256(string_agg(CASE WHEN t.i = w.i THEN w.here ELSE t.h END, '' ORDER BY t.i)),
         w.proof || coalesce(string_agg(CASE WHEN t.i <> w.i THEN t.h END, '' ORDER BY t.i), '')
  FROM lower_walk w JOIN tops s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl < s.high
  JOIN inner_tree t ON t.source IS NOT DISTINCT FROM w.source AND t.lvl = w.lvl AND t.i // 3 = w.i // 3
  GROUP BY w.r, w.source, w.lvl, w.i, w.here, w.proof),
upper_walk AS (
  SELECT w.r, 0 AS lvl, s.i, w.here, w.proof FROM lower_walk w JOIN seated s
  ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.high
  UNION ALL
  SELECT w.r, w.lvl + 1, w.i // 3, sha256(string_agg(CASE WHEN t.i = w.i THEN w.here ELSE t.h END, '' ORDER BY t.i)),
         w.proof || coalesce(string_agg(CASE WHEN t.i <> w.i THEN t.h END, '' ORDER BY t.i), '')
  FROM upper_walk w JOIN top ON w.lvl < top.high JOIN outer_tree t ON t.lvl = w.lvl AND t.i // 3 = w.i // 3
  GROUP BY w.r, w.lvl, w.i, w.here, w.proof)
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(w.proof) AS proof_sha256, w.here AS folded_root, w.here = top.root AS verified
FROM placed p JOIN tops s ON p.source IS NOT DISTINCT FROM s.source JOIN top ON true JOIN upper_walk w ON w.r = p.r AND w.lvl = top.high
"""


@query("op12_merkle_manifest", MERKLE_SQL.replace("{crc}", crc32_sql("doc_id::VARCHAR")))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = {"text": F.when(broken, F.translate("text", "\n", ""))}
    return merkle_manifest.merkle_manifest(documents(spark, sf_dir), found=found)


SPELLING_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc} AS h FROM runs),
words AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS w FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cut AS (SELECT w, p, left(w, p::INT) || substr(w, (p + 2)::INT) AS v FROM (SELECT w, unnest(range(length(w))) AS p FROM words)),
links AS (
  SELECT a.w AS a, b.w AS b FROM cut a JOIN cut b ON a.p = b.p AND a.v = b.v AND a.w <> b.w
  UNION SELECT a.w, b.w FROM cut a JOIN words b ON a.v = b.w
  UNION SELECT b.w, a.w FROM cut a JOIN words b ON a.v = b.w),
ranked AS (
  SELECT a, b, y.n AS bn, x.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) AS k
  FROM links JOIN words x ON x.w = a JOIN words y ON y.w = b),
formed AS (
  SELECT w AS word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * words.n THEN b END AS form,
         CASE WHEN bn >= 10 * words.n THEN bn END AS form_n FROM words LEFT JOIN ranked ON a = w AND k = 1),
walk AS (
  SELECT word, word AS here, 0 AS far FROM formed
  UNION ALL SELECT walk.word, f.form, far + 1 FROM walk JOIN formed f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT max_by(here, far) FROM walk WHERE walk.word = formed.word) AS root, n, n_near, form_n FROM formed
"""


@query("op13_spelling_variants", SPELLING_SQL.replace("{crc}", crc32_sql("doc_id || ':' || run")))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_forms(spelling_variants.word_counts(documents(spark, sf_dir), delete_every=31))
