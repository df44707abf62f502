"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import (byte_bpe, chat, compression_rules, embedding_dedup, filter_audit, fingerprints, line_dedup, mixing, quality,
                           simhash_dedup, spelling, token_counts, warc)
from logspark.llm.common import table, text_of
from logspark.session import scratch_path, stored

#: Folder of the vocabulary files; by default where the public package keeps them.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", os.path.dirname(public_tokenizers.path("x")))


def byte_bpe_tokenizer(spark: SparkSession, folder: str = TOKENIZERS) -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer(spark, os.path.join(folder, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _hex128(hi: str, lo: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.col(c))), 16, "0") for c in (hi, lo)))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edited texts.

    n_near: for ids divisible by 50, how many other documents are within the search radius.
    """
    rows = fingerprints.searched(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", _hex128("hi", "lo").alias("fingerprint"),
                       _hex128("edited_hi", "edited_lo").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


def piece_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of whole ``documents`` texts."""
    counts = token_counts.counts_column(spark, text_of(), os.path.join(TOKENIZERS, "piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", counts.alias("c")).select("doc_id", "c.*")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of ``documents``: fingerprint and smallest document reachable over links."""
    rows = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of whole ``documents`` texts and the bytes decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents")
    done = docs.select("doc_id", byte_bpe.round_trip_column(text_of(), byte_bpe_tokenizer(spark)).alias("r"))
    return done.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one whose texts hold control strings, formatted and read back.

    On the way the conversations are turned into tables of three layouts, which their fingerprints
    turn into turns again.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    turns = stored(chat.canonical_turns(rows.unionByName(extra)), "chat-turns")
    done = chat.format_turns(reduce(DataFrame.unionByName, map(chat.canonical_turns, chat.in_layouts(turns))))
    read = done.select(F.col("id").alias("conv_id"), chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` of equal label at cosine 0.98 or more."""
    rows = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression scores of all ``documents``, learnt from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).withColumnRenamed("id", "doc_id")


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target-weighted mix of all ``documents`` in curriculum order."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as monolithic archives, normalised, and read back record by record."""
    folder = scratch_path(spark, "warc")
    return warc.read_records(warc.normalise(warc.write_archives(table(spark, sf_dir, "pages"), folder), folder), folder)


def line_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy duplicate lines of all ``documents``: what each loses and which documents keep the lines."""
    rows = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").alias("n_dropped"), "dropped", "kept_ids")


def compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and compression bands over whole ``documents`` texts."""
    rows = compression_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "verdict", "ratio", "repetitive_share", "incompressible_share")


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole ``documents`` texts in all their orders, per lang."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    filters = filter_audit.quality_filters(text_of())
    counts = filter_audit.failure_counts(table(spark, sf_dir, "documents"), filters, "E", marks)
    return filter_audit.audit(counts, "ABCDE")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` one edit apart and the frequent form of each."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": document_fingerprints,
    "op2_token_counts": piece_token_counts,
    "op3_simhash_near_dedup": simhash_near_dedup,
    "op4_byte_bpe": byte_bpe_round_trip,
    "op5_chat_formatting": chat_formatting,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_quality_classifier": quality_classifier,
    "op8_source_mixing": source_mixing,
    "op9_warc": warc_round_trip,
    "op10_line_dedup": line_dedup_report,
    "op11_compression_rules": compression_bands,
    "op12_filter_audit": filter_interactions,
    "op13_spelling_variants": spelling_variants,
}

ORACLE: dict[str, str] = {
    "op5_chat_formatting": """
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + 11)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op8_source_mixing": """
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                 md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
          FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        t AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM s),
        f AS (SELECT *, (turn + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM t),
        r AS (SELECT *, cap / weight AS rim FROM f),
        l AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY rim, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY rim, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                 row_number() OVER (ORDER BY rim, source ASC NULLS LAST) AS nth FROM r),
        g AS (SELECT *, least(cap, weight * (SELECT level FROM l WHERE level <= rim ORDER BY nth LIMIT 1)) AS target FROM l),
        p AS (SELECT d.*, g.source_size, g.target, g.turn,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS rounds
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        c AS (SELECT *, rounds + CASE WHEN before + size / 2.0::DOUBLE < target - rounds * source_size THEN 1 ELSE 0 END AS copies,
                 CASE WHEN target > 0 THEN before / target ELSE 0 END AS share FROM p)
        SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
               CASE WHEN copies > 0 THEN round(CASE turn
                 WHEN 0 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
                 WHEN 1 THEN share
                 ELSE CASE WHEN share * 3 < 1 THEN 2 * share * 3 / (1 + sqrt(1 + 8 * share * 3))
                           ELSE 0.5 + 2 * (share * 3 - 1) / (3 + sqrt(9 + 8 * (share * 3 - 1))) END END, 6) END AS position
        FROM c""",
    "op12_filter_audit": """
        WITH RECURSIVE w AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        firsts AS (SELECT text, min(doc_id) AS low FROM w GROUP BY text),
        m AS (
          SELECT doc_id, part,
                 CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
                 || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
          FROM w JOIN firsts USING (text)),
        marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        h AS (
          SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM m LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
          SELECT '' AS o UNION ALL SELECT o || x FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, x)),
        steps AS (
          SELECT o AS filter_order, s::INT AS step, o[s] AS f, o[1:s - 1] AS earlier
          FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5),
        kinds AS (
          SELECT filter_order, step, f, fails, contains(fails, f) AS hit,
                 len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone
          FROM steps, (SELECT DISTINCT fails FROM h)),
        r AS (
          SELECT part, filter_order, step, f,
                 coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
          FROM h JOIN kinds USING (fails) GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM r""",
}
