"""Queries of scans, dictionaries, temporal and text functions, and question understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions import text as X
from ..operators import ground, vector
from ..sources import files
from ..sources.scratch import scratch_path
from ..streaming import ingest
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Scans ----------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """Facts as text lines, some of them broken in each way that a reader meets."""
    f = V.facts_ev(spark, sf_dir)
    n, day = F.col("line_no"), F.col("d").cast("string")
    good = F.concat_ws("\t", "s", "r", "o", day)
    line = (
        F.when(n % 50 == 0, F.concat_ws("\t", "s", "r"))
        .when(n % 50 == 1, F.concat_ws("\t", "s", "r", "o", F.lit("2024-13-77")))
        .when(n % 50 == 2, F.concat_ws("\t", "s", "r", "o"))
        .when(n % 50 == 3, F.concat_ws("\t", "s", "r", F.lit(""), day))
        .when(n % 50 == 4, F.concat(F.lit("\t"), F.concat_ws("\t", "r", "o", day), F.lit(" ")))
        .when(n % 50 == 5, F.concat(F.lit("  "), good, F.lit("\t")))
        .when(n % 50 == 6, F.concat(good, F.lit("T10:30")))
        .when(n % 50 == 7, F.concat_ws("\t", "s", "r", "o", F.substring(day, 1, 4)))
        .otherwise(good)
    )
    return f.select("line_no", line.alias("line"))


LINES = f"""WITH {V.FACTS_EV}, lines AS (SELECT line_no, CASE line_no % 50 WHEN 0 THEN concat_ws(chr(9), s, r) WHEN 1 THEN concat_ws(chr(9), s, r, o, '2024-13-77')
 WHEN 2 THEN concat_ws(chr(9), s, r, o) WHEN 3 THEN concat_ws(chr(9), s, r, '', CAST(d AS VARCHAR)) WHEN 4 THEN chr(9) || concat_ws(chr(9), r, o, CAST(d AS VARCHAR)) || ' '
 WHEN 5 THEN '  ' || concat_ws(chr(9), s, r, o, CAST(d AS VARCHAR)) || chr(9) WHEN 6 THEN concat_ws(chr(9), s, r, o, CAST(d AS VARCHAR)) || 'T10:30'
 WHEN 7 THEN concat_ws(chr(9), s, r, o, substr(CAST(d AS VARCHAR), 1, 4)) ELSE concat_ws(chr(9), s, r, o, CAST(d AS VARCHAR)) END AS line FROM facts),
cut AS (SELECT line_no, string_split(trim(line, ' ' || chr(9)), chr(9)) AS c FROM lines)"""


@query(
    "kg_scan",
    f"""{LINES}, typed AS (SELECT line_no, replace(c[1], '_', ' ') AS s, replace(c[2], '_', ' ') AS r, replace(c[3], '_', ' ') AS o, c[4] AS ts_raw,
 CASE WHEN regexp_full_match(c[4], '\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}})?') THEN TRY_CAST(c[4] AS TIMESTAMP) END AS ts, len(c) AS n FROM cut)
 SELECT line_no, s, r, o, ts_raw, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INTEGER) AS h FROM typed WHERE n >= 3 AND s <> '' AND o <> '' AND (ts_raw IS NULL OR ts IS NOT NULL)""",
)
def kg_scan(spark, sf_dir):
    return files.parse_quads(_lines(spark, sf_dir)).select("line_no", "s", "r", "o", "ts_raw", "d", F.hour("ts").alias("h"))


@query(
    "read_quads",
    f"""{LINES}, typed AS (SELECT row_number() OVER (ORDER BY line_no) AS line_no, replace(c[1], '_', ' ') AS s, replace(c[2], '_', ' ') AS r, replace(c[3], '_', ' ') AS o, c[4] AS ts_raw,
 CASE WHEN regexp_full_match(c[4], '\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}})?') THEN TRY_CAST(c[4] AS TIMESTAMP) END AS ts, len(c) AS n FROM cut)
 SELECT line_no, s, r, o, ts_raw, CAST(ts AS DATE) AS d FROM typed WHERE n >= 3 AND s <> '' AND o <> '' AND (ts_raw IS NULL OR ts IS NOT NULL)""",
)
def read_quads(spark, sf_dir):
    """Through a text folder of several files: written in order, read and numbered again."""
    path = scratch_path(spark)
    _lines(spark, sf_dir).repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    return files.read_quads(spark, path).select("line_no", "s", "r", "o", "ts_raw", "d")


@query(
    "stream_counts",
    f"""WITH {V.FACTS_EV} SELECT CAST(DATE '1970-01-01' + CAST((d - DATE '1970-01-01') // 30 * 30 AS INTEGER) AS DATE) AS start, r, count(*) AS n FROM facts GROUP BY ALL""",
)
def stream_counts(spark, sf_dir):
    """Events as a stream of files, appended exactly once (the second run finds nothing new), counted by window."""
    out, state = scratch_path(spark), scratch_path(spark)
    events = spark.readStream.schema(V.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for _ in range(2):
        ingest.write_stream(V.as_facts(events), out, state).awaitTermination()
    counts = ingest.windowed_counts(spark.read.parquet(out))
    return counts.select(F.col("start").cast("date").alias("start"), "r", "n")


@query("fact_sentences", f"{LINES} SELECT line_no, replace(c[1] || ' ' || c[2] || ' ' || c[3] || ' in ' || c[4], '_', ' ') AS fact FROM cut WHERE len(c) >= 4")
def fact_sentences(spark, sf_dir):
    return files.sentence_corpus(_lines(spark, sf_dir))


@query("dict_entities", "SELECT c_name AS name, CAST(c_custkey AS INTEGER) AS id FROM customer")
def dict_entities(spark, sf_dir):
    return files.parse_dictionary(V.table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_name", "c_custkey").alias("line")))


@query("dict_relations", "SELECT replace(replace(n_name, ' ', '_'), '_', ' ') AS name, n_nationkey AS id FROM nation")
def dict_relations(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    packed = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.translate("n_name", " ", "_"), "n_nationkey")))).alias("json"))
    return files.parse_json_dictionary(packed)


@query("er_lookup_last_wins", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def er_lookup_last_wins(spark, sf_dir):
    return files.last_wins(V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query("resume_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def resume_anti(spark, sf_dir):
    done = V.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return files.not_yet_done(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey")


# Temporal functions ---------------------------------------------------------------------------------


def _dated(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    return o.withColumn("anchor", F.date_add("d", (F.col("id") % 400 - 200).cast("int"))).withColumn("level", F.get(F.array(F.lit("day"), F.lit("month"), F.lit("year"), F.lit("week")), (F.col("id") % 4).cast("int")))


DATED = """WITH dated AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 200 AS INTEGER) AS anchor,
 ['day','month','year','week'][o_orderkey % 4 + 1] AS level FROM orders)"""
_SAME = "CASE level WHEN 'day' THEN d = anchor WHEN 'month' THEN year(d) = year(anchor) AND month(d) = month(anchor) WHEN 'year' THEN year(d) = year(anchor) ELSE false END"


@query("time_match_level", f"{DATED} SELECT id, {_SAME} AS hit FROM dated")
def time_match_level(spark, sf_dir):
    return _dated(spark, sf_dir).select("id", T.matches(F.col("d"), F.col("anchor"), F.col("level")).alias("hit"))


@query("time_compare_level", f"{DATED} SELECT id, CAST(CASE WHEN level = 'week' OR {_SAME} THEN 0 WHEN d < anchor THEN -1 ELSE 1 END AS INTEGER) AS sign FROM dated")
def time_compare_level(spark, sf_dir):
    return _dated(spark, sf_dir).select("id", T.compare(F.col("d"), F.col("anchor"), F.col("level")).alias("sign"))


def _asking(spark, sf_dir):
    o, d = _dated(spark, sf_dir), F.col("d")
    f = lambda p: F.date_format(d, p)
    forms = [
        F.concat(F.lit("who visited on "), f("yyyy-MM-dd"), F.lit("?")),
        F.concat(F.lit("what happened in "), f("MMMM yyyy")),
        F.concat(F.lit("Before "), f("d MMMM yyyy"), F.lit(", who")),
        F.concat(F.lit("since "), f("yyyy"), F.lit(" who")),
        F.concat(F.lit("signed "), f("dd-MM-yyyy")),
        F.concat(F.lit("after "), f("MMM d, yyyy")),
        F.concat(F.lit("during "), f("yyyy-MM"), F.lit(".")),
        F.lit("who met whom"),
    ]
    return o.select("id", "d", F.get(F.array(*forms), (F.col("id") % 8).cast("int")).alias("text"))


ASKING = f"""{DATED}, asking AS (SELECT id, d, CASE id % 8 WHEN 0 THEN 'who visited on ' || strftime(d, '%Y-%m-%d') || '?' WHEN 1 THEN 'what happened in ' || strftime(d, '%B %Y')
 WHEN 2 THEN 'Before ' || day(d) || strftime(d, ' %B %Y') || ', who' WHEN 3 THEN 'since ' || year(d) || ' who' WHEN 4 THEN 'signed ' || strftime(d, '%d-%m-%Y')
 WHEN 5 THEN 'after ' || strftime(d, '%b ') || day(d) || ', ' || year(d) WHEN 6 THEN 'during ' || strftime(d, '%Y-%m') || '.' ELSE 'who met whom' END AS text FROM dated)"""


@query(
    "extract_time",
    f"""{ASKING} SELECT id, text, CASE WHEN id % 8 IN (0, 2, 5) THEN strftime(d, '%Y-%m-%d') WHEN id % 8 IN (1, 6) THEN strftime(d, '%Y-%m') WHEN id % 8 = 3 THEN strftime(d, '%Y')
 WHEN id % 8 = 4 THEN CASE WHEN day(d) <= 12 THEN strftime(d, '%Y-%d-%m') ELSE strftime(d, '%Y-%m-%d') END END AS found FROM asking""",
)
def extract_time(spark, sf_dir):
    return _asking(spark, sf_dir).select("id", "text", T.time_expression(F.col("text")).alias("found"))


@query("parse_text_date", f"{ASKING} SELECT id, CASE WHEN id % 8 IN (0, 2) THEN d WHEN id % 8 IN (1, 6) THEN CAST(date_trunc('month', d) AS DATE) END AS found FROM asking")
def parse_text_date(spark, sf_dir):
    return _asking(spark, sf_dir).select("id", T.parse_text_date(F.col("text")).alias("found"))


@query(
    "parse_iso_date",
    f"""{DATED} SELECT id, CAST(CASE id % 5 WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('year', d) END AS DATE) AS found FROM dated""",
)
def parse_iso_date(spark, sf_dir):
    o, d = _dated(spark, sf_dir), F.col("d")
    text = F.get(F.array(d.cast("string"), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy"), F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")), F.lit("215")), (F.col("id") % 5).cast("int"))
    return o.select("id", T.parse_iso(text).alias("found"))


@query(
    "is_date_entity",
    f"""{DATED} SELECT id, id % 8 IN (0, 1, 2, 5, 7) OR (id % 8 = 6 AND id BETWEEN 1000 AND 9999) AS is_date FROM dated""",
)
def is_date_entity(spark, sf_dir):
    o, d = _dated(spark, sf_dir), F.col("d")
    forms = [F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM"), F.date_format(d, " d MMMM yyyy"), F.concat(F.date_format(d, "MMMM"), F.lit(" Institute")), F.lit("City Mayor"), F.concat(F.date_format(d, "MMMM"), F.lit(" on Rome")), F.concat(F.lit("Customer "), "id"), F.date_format(d, "d MMMM")]
    return o.select("id", T.is_date_entity(F.get(F.array(*forms), (F.col("id") % 8).cast("int"))).alias("is_date"))


@query(
    "kappa_bucket",
    f"""{V.POOLS} SELECT quid, pos, CAST(CASE WHEN cue IN ('before', 'after') THEN floor(coalesce(d - anchor, d - DATE '0001-01-01' + 1) / 7.0) WHEN cue IN ('first', 'last') THEN pos
 ELSE d - DATE '0001-01-01' + 1 END AS BIGINT) AS kappa FROM pool JOIN cues USING (quid)""",
)
def kappa_bucket(spark, sf_dir):
    p = V.pools(spark, sf_dir).join(V.pool_cues(spark, sf_dir), "quid")
    return p.select("quid", "pos", T.kappa(F.col("d"), F.col("cue"), F.col("anchor"), F.col("pos"), 7).alias("kappa"))


@query(
    "parse_fact",
    f"""{LINES}, raw AS (SELECT line_no, string_split(line, chr(9)) AS c FROM lines), p AS (SELECT line_no, c[1] AS s, c[2] AS r, c[3] AS o, TRY_CAST(substr(c[4], 1, 10) AS DATE) AS d, len(c) AS n, c[4] AS t FROM raw)
 SELECT line_no, s, r, o, d FROM p WHERE n >= 4 AND d IS NOT NULL AND regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')""",
)
def parse_fact(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_no", T.parse_fact(F.col("line")).alias("x")).where("x is not null").select("line_no", "x.*")


# Question understanding -----------------------------------------------------------------------------


@query("norm_ws", "SELECT p_partkey AS id, p_name || ' ' || p_type || ' x' AS text FROM part")
def norm_ws(spark, sf_dir):
    messy = F.concat(F.lit(" \t"), "p_name", F.lit(" \n  "), "p_type", F.lit("\t\tx  "))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.squeeze(messy).alias("text"))


@query(
    "ner_dict",
    """WITH q AS (SELECT c_custkey AS quid, 'What did ' || n_name || ' sell in ' || r_name || ', and to ' || c_mktsegment || '?' AS question FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 names AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region),
 hit AS (SELECT quid, name FROM q JOIN names ON contains(' ' || lower(regexp_replace(question, '[\\s?!.,;:"]+', ' ', 'g')) || ' ', ' ' || lower(name) || ' '))
 SELECT quid, name AS entity FROM hit QUALIFY row_number() OVER (PARTITION BY quid ORDER BY length(name) DESC, name) = 1""",
)
def ner_dict(spark, sf_dir):
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    q = V.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    q = q.select(F.col("c_custkey").alias("quid"), F.concat(F.lit("What did "), "n_name", F.lit(" sell in "), "r_name", F.lit(", and to "), "c_mktsegment", F.lit("?")).alias("question"))
    return ground.dictionary_entities(q, n.select(F.col("n_name").alias("name")).union(r.select("r_name")).distinct())


_MISSPELT = """CASE c_custkey % 4 WHEN 0 THEN concat(substr(c_name, 1, 2), substr(c_name, 4)) WHEN 1 THEN concat(substr(c_name, 1, 1), substr(c_name, 3, 4), substr(c_name, 8))
 WHEN 2 THEN concat(substr(c_name, 3), 'x') ELSE concat('~', c_mktsegment, c_custkey % 100) END"""
_NAMES = "names AS (SELECT DISTINCT {} AS name FROM customer), dict AS (SELECT c_name AS entity FROM customer UNION SELECT p_name FROM part)"


def _misspelt(spark, sf_dir):
    """Customers with one, two or three letters wrong, or names that are like none, and a dictionary of customers and parts."""
    c = V.table(spark, sf_dir, "customer")
    return c.select(F.expr(_MISSPELT).alias("name")), c.select(F.col("c_name").alias("name")).union(V.table(spark, sf_dir, "part").select("p_name"))


@query(
    "entity_fuzzy_lev",
    f"""WITH {_NAMES.format(_MISSPELT)}
 SELECT name, entity, CAST(levenshtein(name, entity) AS INTEGER) AS distance FROM names, dict QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, entity), entity) = 1""",
)
def entity_fuzzy_lev(spark, sf_dir):
    return ground.nearest_by_levenshtein(*_misspelt(spark, sf_dir))


@query("entity_fuzzy")
def entity_fuzzy(spark, sf_dir):
    return ground.close_matches(*_misspelt(spark, sf_dir))


def _vectors(spark, sf_dir):
    """Every 25th vector, turned round, as a query; all vectors as the corpus."""
    e = V.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("quid"), F.reverse("embedding").alias("vector"))
    return q, e.select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector"))


VECTORS = """WITH pairs AS (SELECT a.vec_id AS quid, b.vec_id AS fact_id, list_sum(list_transform(list_zip(list_reverse(a.embedding), b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0)"""


def _top(k: int, where: str = "true", order: str = "fact_id") -> str:
    return f"SELECT quid, CAST(row_number() OVER (PARTITION BY quid ORDER BY score DESC, {order}) AS INTEGER) AS rank, fact_id, round(score, 6) AS score FROM pairs WHERE {where} QUALIFY rank <= {k}"


@query("vec_dot", "SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_dot(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select(F.col("vec_id").alias("id"), F.round(vector.dot(F.col("embedding"), F.col("next")), 6).alias("score"))


@query("vec_topk", f"{VECTORS} {_top(20)}")
def vec_topk(spark, sf_dir):
    return vector.top_k(*_vectors(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@query("vec_topk_ivf", f"{VECTORS} {_top(20)}")
def vec_topk_ivf(spark, sf_dir):
    return vector.top_k_cells(*_vectors(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@query("vec_index_grow", f"{VECTORS} {_top(20)}")
def vec_index_grow(spark, sf_dir):
    """A kept index of the even labels' vectors takes the others, and some of the first again, and is searched."""
    q, c = _vectors(spark, sf_dir)
    e = V.table(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector"))
    index = vector.VectorIndex.build(e, scratch_path(spark), cells=64)
    index.add(c)
    return index.search(q, 20).withColumn("score", F.round("score", 6))


@query("vec_gather", f"{VECTORS}, top AS ({_top(20)}) SELECT quid, rank, fact_id, 'fact ' || label || ' of ' || vec_id AS fact FROM top JOIN embeddings ON vec_id = fact_id WHERE label <> 3")
def vec_gather(spark, sf_dir):
    texts = V.table(spark, sf_dir, "embeddings").where("label <> 3").select(F.col("vec_id").alias("fact_id"), F.concat(F.lit("fact "), "label", F.lit(" of "), "vec_id").alias("fact"))
    return vector.gather(vector.top_k(*_vectors(spark, sf_dir), 20), texts).select("quid", "rank", "fact_id", "fact")


@query("relation_topk", f"{VECTORS} {_top(3, 'fact_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)', 'fact_id DESC')}")
def relation_topk(spark, sf_dir):
    """The dictionary is a vector for each label."""
    names = V.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector")), "vec_id").alias("x")).select("x.*")
    return vector.top_k(_vectors(spark, sf_dir)[0], names, 3, larger_id_first=True).withColumn("score", F.round("score", 6))


@query("entity_top1", f"{VECTORS} {_top(1)}")
def entity_top1(spark, sf_dir):
    return vector.top_k(*_vectors(spark, sf_dir), 1).withColumn("score", F.round("score", 6))


def _grams(table: str, key: str, text: str) -> str:
    """CTEs that encode texts as the offline encoder does: ``enc`` (key, dim, value) without zeros."""
    return f"""low AS (SELECT DISTINCT {key} AS key, lower({text}) AS t FROM {table}),
 gram AS (SELECT key, unnest(regexp_extract_all(t, '\\w+')) AS g FROM low UNION ALL SELECT key, substr(t, CAST(i AS INTEGER), 3) FROM low, unnest(range(1, length(t) - 1)) AS u(i)),
 part_of AS (SELECT key, CAST('0x' || substr(md5(g), 1, 4) AS INTEGER) % 256 AS dim, sum(CASE WHEN substr(md5(g), 5, 1) >= '8' THEN 1.0 ELSE -1.0 END) AS v FROM gram GROUP BY ALL),
 enc AS (SELECT key, dim, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS value FROM part_of WHERE v <> 0)"""


@query("encode_texts", f"WITH {_grams('part', 'p_partkey', 'p_name')} SELECT key AS p_partkey, CAST(dim AS INTEGER) AS dim, round(value, 3) AS value FROM enc")
def encode_texts(spark, sf_dir):
    v = vector.encode_texts(V.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    return v.select("p_partkey", F.posexplode("vector").alias("dim", "value")).where("value <> 0").select("p_partkey", "dim", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("semantic_search")
def semantic_search(spark, sf_dir):
    return vector.semantic_search(V.questions(spark, sf_dir), files.fact_sentences(V.facts_ev(spark, sf_dir)))


@query(
    "rank_relations",
    f"""WITH asked AS (SELECT DISTINCT event_type || 'ed' AS name FROM events), known AS (SELECT DISTINCT event_type AS name FROM events), every AS (FROM asked UNION FROM known),
 {_grams('every', 'name', 'name')}, score AS (SELECT a.key AS relation, b.key AS rel, sum(a.value * b.value) AS score FROM enc a JOIN enc b USING (dim) WHERE a.key IN (FROM asked) AND b.key IN (FROM known) GROUP BY ALL)
 SELECT asked.name AS relation, CAST(row_number() OVER (PARTITION BY asked.name ORDER BY round(coalesce(score, 0), 6) DESC, length(known.name) * 1000 + ascii(known.name) DESC) AS INTEGER) AS cand_rank, known.name AS rel
 FROM asked CROSS JOIN known LEFT JOIN score ON score.relation = asked.name AND score.rel = known.name QUALIFY cand_rank <= 3""",
)
def rank_relations(spark, sf_dir):
    f = V.facts_ev(spark, sf_dir)
    names = f.select(F.col("r").alias("name")).distinct()
    return vector.rank_relations(f.select(F.concat("r", F.lit("ed")).alias("relation")), names.withColumn("id", F.length("name") * 1000 + F.ascii("name")))


def _scored(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20 / 20.0).alias("score"), F.concat(F.lit("E"), F.col("s_suppkey") % 9).alias("semantic"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("E"), F.col("s_suppkey") % 7)).alias("fuzzy"))


SCORED = "WITH scored AS (SELECT s_suppkey AS id, s_suppkey % 20 / 20.0 AS score, 'E' || s_suppkey % 9 AS semantic, CASE WHEN s_suppkey % 4 <> 0 THEN 'E' || s_suppkey % 7 END AS fuzzy FROM supplier)"


@query("entity_choose", f"{SCORED} SELECT id, CASE WHEN score > 0.85 THEN semantic ELSE fuzzy END AS entity FROM scored WHERE score > 0.85 OR fuzzy IS NOT NULL")
def entity_choose(spark, sf_dir):
    return ground.choose_entity(_scored(spark, sf_dir)).select("id", "entity")


@query("entity_mismatch", f"{SCORED} SELECT id, semantic, fuzzy FROM scored WHERE semantic IS DISTINCT FROM fuzzy")
def entity_mismatch(spark, sf_dir):
    return ground.mismatches(_scored(spark, sf_dir)).select("id", "semantic", "fuzzy")


def _entity_tables(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("quid"), F.array("c_name", F.upper("c_mktsegment"), F.lit(None)).alias("entities"))
    d = V.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("quid"), F.array(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.lit("Other ")), F.concat(F.lit(" "), "c_name"), F.lit("")).alias("entities"))
    return c, d


@query("entity_conflicts", "SELECT c_custkey AS quid, greatest(lower(c_name), lower(c_mktsegment)) AS last_left, greatest(lower(c_name), 'other') AS last_right FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 <> 0")
def entity_conflicts(spark, sf_dir):
    return ground.entity_conflicts(*_entity_tables(spark, sf_dir)).select("quid", F.element_at("left_entities", -1).alias("last_left"), F.element_at("right_entities", -1).alias("last_right"))


@query(
    "arbitrate_apply",
    """SELECT c_custkey AS quid, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_mktsegment END ELSE c_name || '|' || upper(c_mktsegment) END AS entities,
 CASE WHEN c_custkey % 4 = 0 THEN 'arbitrated' END AS arbitration FROM customer WHERE c_custkey % 3 <> 0""",
)
def arbitrate_apply(spark, sf_dir):
    left, _ = _entity_tables(spark, sf_dir)
    verdicts = V.table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("quid"), F.when(F.col("c_custkey") % 8 != 0, F.array("c_mktsegment")).alias("chosen"))
    out, _ = ground.apply_arbitration(left, verdicts)
    return out.select("quid", F.array_join("entities", "|").alias("entities"), "arbitration")


def _replies(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    body = F.concat(F.lit('{"subject": "'), "s_name", F.lit('", "relation": "sell", "cue": null}'))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("s_suppkey") % 3 == 1, body).otherwise(F.lit("sorry, no"))
    return s.select(F.col("s_suppkey").alias("quid"), raw.alias("raw"))


@query(
    "parse_relation_json",
    """SELECT s_suppkey AS quid, CASE WHEN s_suppkey % 3 = 2 THEN 'None' ELSE s_name END AS subject, CASE WHEN s_suppkey % 3 = 2 THEN 'None' ELSE 'sell' END AS relation, 'None' AS object, 'None' AS cue,
 'None' AS reference_target, CASE WHEN s_suppkey % 3 = 2 THEN 'sorry, no' END AS raw_output FROM supplier""",
)
def parse_relation_json(spark, sf_dir):
    return ground.parse_relations(_replies(spark, sf_dir))


@query(
    "merge_entity_relation",
    """WITH last AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
 SELECT c_custkey AS quid, coalesce(o_orderpriority, 'None') AS relation, coalesce(o_orderstatus, 'None') AS subject, 'None' AS object, 'None' AS cue, 'None' AS reference_target FROM customer LEFT JOIN last ON o_custkey = c_custkey""",
)
def merge_entity_relation(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("quid"), F.lit("x").alias("fuzzy_top1_entities"))
    r = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("quid"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("relation"), *[F.lit(None).cast("string").alias(x) for x in ("object", "cue", "reference_target")])
    return ground.merge_relations(c, r)


@query("cand_fanout", f"{V.BASE} SELECT quid, cand_rank, rel FROM qc")
def cand_fanout(spark, sf_dir):
    ranked = V.candidates(spark, sf_dir).join(V.questions(spark, sf_dir).select("quid", "relation"), "quid").select("relation", "cand_rank", "rel").distinct()
    return ground.spread(V.questions(spark, sf_dir), ranked)
