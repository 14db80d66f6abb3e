"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantfuse.llm import (
    alignment,
    bpe,
    decontaminate,
    html_main,
    language,
    lexical,
    line_dedup,
    packing,
    pii,
    prefix_hash,
    quotes,
    simhash_cover,
    sparse_suffix,
)
from plantfuse.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens of a packed sequence.
CAPACITY = 2048


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op2_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.compared_with_next(table(spark, sf_dir, "documents")).withColumnRenamed(
        "id", "doc_id"
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(text_id.cast("binary")) % 3 == 1
    model = language.fit(docs, ~held_out)
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score"
    )


def op5_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sparse_suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("id").alias("doc_id"),
        F.col("first").alias("first_word"),
        F.col("end").alias("end_word"),
        "n_later",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_data(table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("id").alias("doc_id"),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"),
        pii.joined([*pii.BASE, *pii.VOTES]).alias("spans"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_shared_lines(docs, result="lines").select(
        "doc_id",
        "lines.n_lines",
        "lines.n_dropped",
        F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )


def op13_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY
    )
    measured = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.packed(measured, CAPACITY).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


QUERIES: dict[str, Query] = {
    "op1_quote_linking": op1_quote_linking,
    "op2_simhash_cover": op2_simhash_cover,
    "op3_prefix_hash": op3_prefix_hash,
    "op4_language": op4_language,
    "op5_sparse_suffix": op5_sparse_suffix,
    "op6_decontaminate": op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_main_text": op8_main_text,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_packing": op13_exact_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (
  SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM lengths
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms
  WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, totals GROUP BY term, documents
), scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total))))::BIGINT AS score
  FROM item_terms JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scores WHERE score > 0
) WHERE rank <= 10
""",
    "op1_quote_linking": r"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, role,
    string_split(replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), chr(13), ''), chr(10)) AS lines
  FROM conversations
), lines AS (
  SELECT conv_id, turn, role, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM messages
), levels AS (
  SELECT *, regexp_extract(line, '^([> 	]*)', 1) AS marks,
    length(replace(replace(regexp_extract(line, '^([> 	]*)', 1), ' ', ''), chr(9), '')) AS level
  FROM lines
), bodies AS (
  SELECT *, CASE WHEN level > 0 THEN substr(line, length(marks) + 1) ELSE line END AS body,
    level = 0 AND coalesce(lead(level) OVER message, 0) > 0 AND regexp_matches(line,
      '(?i)(^|[\s>\]])(wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|escreveu)\s*:\s*$'
    ) AS introduces
  FROM levels WINDOW message AS (PARTITION BY conv_id, turn, role ORDER BY pos)
), runs AS (
  SELECT *, sum(CASE WHEN level = before AND NOT introduces AND trim(body, ' ') <> ''
      AND trim(body_before, ' ') <> '' AND NOT after_introduction THEN 0 ELSE 1 END)
    OVER (PARTITION BY conv_id, turn, role ORDER BY pos) AS run
  FROM (SELECT *, lag(level) OVER message AS before, lag(body) OVER message AS body_before,
      coalesce(lag(introduces) OVER message, false) AS after_introduction
    FROM bodies WINDOW message AS (PARTITION BY conv_id, turn, role ORDER BY pos))
), passages AS (
  SELECT conv_id, turn, role, min(pos) AS pos, any_value(level) AS level,
    list(lower(trim(regexp_replace(body, '[\s\p{Z}]+', ' ', 'g'), ' ')) ORDER BY pos) AS said,
    lower(trim(regexp_replace(string_agg(body, chr(10) ORDER BY pos), '[\s\p{Z}]+', ' ', 'g'), ' ')) AS passage
  FROM runs WHERE NOT introduces AND trim(body, ' ') <> '' GROUP BY conv_id, turn, role, run
), quoted AS (
  SELECT *, row_number() OVER () AS quote,
    list_prepend(passage, list_transform(list_sort(list_transform(list_filter(said, lambda x: x <> ''),
      lambda x, i: {'size': -length(x), 'at': i, 'line': x})), lambda x: x.line)) AS keys
  FROM passages WHERE level > 0
), own AS (
  SELECT conv_id, turn, passage AS said FROM passages WHERE level = 0
  UNION SELECT conv_id, turn, unnest(said) FROM passages WHERE level = 0
), here AS (SELECT said, conv_id, min(turn) AS turn FROM own GROUP BY ALL),
asked AS (
  SELECT quote, conv_id, turn, generate_subscripts(keys, 1) AS rank, unnest(keys) AS key FROM quoted
), before AS (
  SELECT quote, arg_min(h.turn, rank) AS original
  FROM asked a JOIN here h ON h.said = a.key AND h.conv_id = a.conv_id
  WHERE h.turn < a.turn GROUP BY quote
), others AS (
  SELECT DISTINCT quote, true AS elsewhere
  FROM asked a JOIN here h ON h.said = a.key AND h.conv_id <> a.conv_id
), linked AS (
  SELECT conv_id, turn, level, pos, original, coalesce(elsewhere, false) AS elsewhere
  FROM quoted LEFT JOIN before USING (quote) LEFT JOIN others USING (quote)
), replies AS (
  SELECT conv_id, turn, count(*) FILTER (WHERE original IS NOT NULL OR elsewhere) AS n_linked,
    arg_min(original, (level, pos)) FILTER (WHERE original IS NOT NULL) AS reply_to
  FROM linked GROUP BY ALL
), threads AS (
  SELECT conv_id, turn, reply_to AS root, CAST(1 AS BIGINT) AS depth FROM replies WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT t.conv_id, t.turn, r.reply_to, t.depth + 1 FROM threads t
  JOIN replies r ON r.conv_id = t.conv_id AND r.turn = t.root AND r.reply_to IS NOT NULL
), tops AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM threads GROUP BY ALL),
counts AS (
  SELECT conv_id, turn, role, count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS deepest
  FROM passages GROUP BY ALL
), texts AS (
  SELECT conv_id, turn, role,
    trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT introduces), ''),
      ' ' || chr(9) || chr(10) || chr(11) || chr(12)) AS text
  FROM bodies GROUP BY ALL
)
SELECT conv_id, turn, role, text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
  CAST(coalesce(deepest, 0) AS BIGINT) AS deepest, reply_to, coalesce(root, turn) AS thread,
  coalesce(depth, 0) AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(root, turn), turn, role, text) AS reply_order
FROM texts LEFT JOIN counts USING (conv_id, turn, role) LEFT JOIN replies USING (conv_id, turn)
LEFT JOIN tops USING (conv_id, turn)
""",
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents
), keyed AS (
  SELECT *, translate(
      trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS kept_in FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, shared.key IS NOT NULL AND doc_id <> kept_in AS gone
  FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
