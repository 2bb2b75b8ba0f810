"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_documents, encode_documents, read_ranks
from .extract import extract_pages
from .language import held_out, identify, train_languages
from .leaks import benchmark_hits
from .lexical import rank_documents
from .lines import dedup_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .quality import score_quality, train_quality
from .session import read_table
from .sharding import shard_documents
from .tokens import read_vocabulary, token_counts
from .vectors import nearest

NEAR_PERCENT = 75
SHINGLE = 5


def vocabulary_path(spark: SparkSession) -> str:
    """The file that the session's ``quadrille.vocabulary`` names, else that of the public package; it is read on the driver only."""
    return spark.conf.get("quadrille.vocabulary", None) or public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=SHINGLE, percent=NEAR_PERCENT)


SHARDS = 40
MIX_SEED = 42


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality and toxicity score for every document, learned from the labels."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


def op4_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Words and word pieces of every document, by the vocabulary file of the session's ``quadrille.vocabulary``."""
    return token_counts(read_table(spark, sf_dir, "documents"), read_vocabulary(vocabulary or vocabulary_path(spark)))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train_languages(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of each vector whose id is divisible by 20, among all others."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of three-line windows that stand earlier in the table."""
    return dedup_lines(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document."""
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=SHARDS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, and its source's target."""
    return mix_sources(read_table(spark, sf_dir, "documents"), seed=MIX_SEED).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it repeats; clean documents have none."""
    return benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


RANKED = 50


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=RANKED)


def op12_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of every document's token ids and of the bytes that they decode to."""
    ranks = read_ranks(vocabulary or vocabulary_path(spark))
    coded = decode_documents(encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_extract": op1_extract,
    "op2_neardup": op2_neardup,
    "op3_quality": op3_quality,
    "op4_tokens": op4_tokens,
    "op5_langid": op5_langid,
    "op6_ann": op6_ann,
    "op7_linededup": op7_linededup,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_lexical": op11_lexical,
    "op12_bpe": op12_bpe,
}

ORACLES = {
    "op11_lexical": r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), filled AS (SELECT row_number() OVER () AS d, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM found WHERE len(t) > 0),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS len FROM filled),
items AS (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), tf AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(t) AS t FROM filled) WHERE t IN (SELECT t FROM items) GROUP BY d, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), corpus
), impacts AS (
  SELECT d, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // len))) AS x FROM tf JOIN weights USING (t) JOIN filled USING (d), corpus
), scored AS (SELECT i, item_id, d, doc_id, CAST(sum(x) AS BIGINT) AS score FROM items JOIN impacts USING (t) JOIN filled USING (d) GROUP BY ALL HAVING sum(x) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 50
""",
    "op7_linededup": r"""
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(l[i:i+2], chr(10)) AS w FROM lined, unnest(range(1, len(l) - 1)) AS u(i)
  WHERE trim(l[i], ' ') <> '' OR trim(l[i+1], ' ') <> '' OR trim(l[i+2], ' ') <> ''
), marked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM win),
covered AS (SELECT DISTINCT doc_id, pos + d AS pos FROM marked, unnest([0, 1, 2]) AS u(d) WHERE k > 1),
kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE c.pos IS NULL) AS text, count(c.pos) AS gone
  FROM (SELECT doc_id, i - 1 AS i, l[i] AS line FROM lined, unnest(range(1, len(l) + 1)) AS u(i)) x
  LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.pos = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed
FROM lined d LEFT JOIN kept k USING (doc_id)
""",
    "op8_sharding": r"""
WITH RECURSIVE step AS (
  SELECT i, 0 AS r, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, r + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE r < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE r = 8),
byte AS (
  SELECT doc_id, text, list_transform(range(1, length(hex(encode(text))), 2), lambda i: CAST('0x' || substr(hex(encode(text)), i, 2) AS BIGINT)) AS b FROM documents
), base AS (
  SELECT doc_id, CAST(coalesce(len(b), 0) + 16 AS BIGINT) AS size, b, t FROM byte, crc
), summed AS (
  SELECT doc_id, size, CAST(CASE WHEN b IS NULL THEN NULL ELSE xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) END AS BIGINT) AS text_crc32 FROM base
), placed AS (
  SELECT doc_id, size, text_crc32, substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS part,
    arg_max(s, (substr(md5(concat(doc_id, '/', s)), 1, 13), -s)) FILTER (WHERE s < 40) AS shard,
    arg_max(s, (substr(md5(concat(doc_id, '/', s)), 1, 13), -s)) AS grown_shard
  FROM summed, range(41) AS r(s) GROUP BY ALL
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM placed
""",
    "op2_neardup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sized AS (SELECT doc_id, coalesce(len(s), 0) AS n, s FROM shingled),
tokens AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sized s JOIN component c USING (doc_id)
""",
}
