"""F7 / F8 by an index: search without reading texts.

``write_term_index`` writes two tables beside an event store: the dictionary of the distinct
words of all search documents, and postings (word, day, source, event id), range-partitioned
and sorted by word. A search term is an alphanumeric run, so it can only lie inside one word
of a document: it holds for an event just if one of the event's words holds it or is within
the term's edit distance. Terms are matched against the dictionary, once for all of them, and
the words found join the postings; the event's text column is never read. The dictionary grows
with the vocabulary. A word that a third of all events have is one dictionary row, and its
postings are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators import filters as FI

POSTING = ["event_date", "source", "event_id"]


def postings(events: DataFrame) -> DataFrame:
    """(word, event_date, source, event_id): each distinct word of an event's search document."""
    stored = events.columns
    document = F.col("search_document") if "search_document" in stored else C.search_document()
    day = F.col("event_date") if "event_date" in stored else F.to_date("timestamp")
    words = F.filter(F.array_distinct(F.split(document, C.NON_WORD_RUN)), lambda w: w != "")
    return events.select(F.explode(words).alias("word"), day.alias("event_date"), "source", "event_id")


def write_term_index(events: DataFrame, path: str) -> None:
    """Dictionary and postings of ``events`` (an event store's rows, or any event frame) below ``path``."""
    found = postings(events)
    found.repartitionByRange("word", "event_id").sortWithinPartitions("word", "event_id").write.parquet(f"{path}/postings")
    written = events.sparkSession.read.parquet(f"{path}/postings").select("word")
    written.groupBy("word").agg(F.count(F.lit(1)).alias("events")).write.parquet(f"{path}/words")


def _word_matches(term: str, fuzzy: bool) -> Column:
    """Whether a dictionary word makes a document that has it a hit for the term."""
    word, n = F.col("word"), len(term.encode())
    inside = F.contains(word, F.lit(term))
    if not fuzzy or n < 4 or n > 64:
        return inside
    edits = 2 if n >= 8 else 1
    near = (F.abs(F.octet_length(word) - n) <= edits) & (F.octet_length(word) <= 64)
    return inside | (near & (F.levenshtein(FI._latin1(word), F.lit(term.encode().decode("latin-1")), edits) >= 0))


def matching_words(words: DataFrame, terms: list[str], fuzzy: bool = True) -> DataFrame:
    """(word, term number) of every dictionary word that a term finds; one scan for all terms."""
    hits = F.array_compact(F.array(*(F.when(_word_matches(t, fuzzy), F.lit(i)) for i, t in enumerate(terms))))
    return words.select("word", F.explode(hits).alias("term"))


def search_hits(spark: SparkSession, path: str, text: str, fuzzy: bool = True, after_event_id: int | None = None) -> DataFrame | None:
    """(event_date, source, event_id) of the events that every term of ``text`` finds; None without a term (all events)."""
    terms = list(dict.fromkeys(FI.search_terms(text)))
    if not terms:
        return None
    found = spark.read.parquet(f"{path}/postings")
    if after_event_id is not None:
        found = found.where(F.col("event_id") > after_event_id)
    hits = found.join(matching_words(spark.read.parquet(f"{path}/words"), terms, fuzzy), "word")
    if len(terms) == 1:
        return hits.select(*POSTING).distinct()
    # a bit a term: partial aggregation leaves one number an event and task
    bits = hits.groupBy(*POSTING).agg(*(F.max(F.col("term") == i).alias(f"t{i}") for i in range(len(terms))))
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & F.col(f"t{i}")
    return bits.where(every).select(*POSTING)


def search_indexed(events: DataFrame, path: str, text: str, fuzzy: bool = True, after_event_id: int | None = None) -> DataFrame:
    """The event store's rows that ``filters.search`` would return, found by the index.

    Rows are picked by day, source and id, so the store's partitions are pruned and only the
    columns that the caller selects are read.
    """
    rows = events if after_event_id is None else events.where(F.col("event_id") > after_event_id)
    hits = search_hits(events.sparkSession, path, text, fuzzy, after_event_id)
    return rows if hits is None else rows.join(hits, POSTING, "left_semi")
