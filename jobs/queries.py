"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs.cue_graph import grow_cue_graph, read_edges
from jobs.sentence_corpus import build_sentence_corpus, read_corpus
from quadrille.plans.registry import ORACLES as CORE
from quadrille.sources.scratch import scratch_path


def job1_cue_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue graph of all events; the second run finds nothing new."""
    folder = scratch_path(spark)
    for _ in range(2):
        grow_cue_graph(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return read_edges(spark, f"{folder}/out")


def job2_sentence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different sentences of all documents and conversations; the second run writes the same again."""
    folder = scratch_path(spark)
    for _ in range(2):
        build_sentence_corpus(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", f"{folder}/out")
    return read_corpus(spark, f"{folder}/out")


QUERIES = {"job1_cue_graph": job1_cue_graph, "job2_sentence_corpus": job2_sentence_corpus}

ORACLES = {
    "job1_cue_graph": f"SELECT *, substr(time_2, 1, 7) AS month FROM ({CORE['cue_after_obj']})",
    "job2_sentence_corpus": r"""
WITH texts AS (
  SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS part, lang, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, NULL, text FROM conversations
), cut AS (SELECT origin, id, part, lang, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM texts),
found AS (SELECT origin, id, part, lang, CAST(i - 1 AS INTEGER) AS pos, trim(regexp_replace(s[i], '\s+', ' ', 'g')) AS sentence FROM cut, unnest(range(1, len(s) + 1)) AS u(i)),
keyed AS (
  SELECT *, list_filter(string_split_regex(translate(lower(sentence), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS w FROM found
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS n_seen, row_number() OVER (PARTITION BY w ORDER BY origin, id NULLS FIRST, part NULLS FIRST, pos, sentence, lang NULLS FIRST) AS k FROM keyed WHERE len(w) >= 2
)
SELECT sentence, id, part, pos, n_seen, CAST(len(w) AS INTEGER) AS n_words,
  nullif(regexp_extract(concat_ws(' ', CASE WHEN regexp_matches(lower(sentence), '\bbefore\b') THEN 'before' END, CASE WHEN regexp_matches(lower(sentence), '\bafter\b') THEN 'after' END,
    CASE WHEN regexp_matches(lower(sentence), '\bfirst\b') THEN 'first' END, CASE WHEN regexp_matches(lower(sentence), '\blast\b') THEN 'last' END, CASE WHEN regexp_matches(lower(sentence), '\bsame\b') THEN 'same' END), '^\w+'), '') AS cue,
  origin, lang FROM ranked WHERE k = 1
""",
}
