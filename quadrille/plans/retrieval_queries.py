"""Queries of the graph, cue and retrieval operators, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import render_fact
from ..operators import cue, graph, retrieve
from ..sources import fact_store
from ..sources.scratch import scratch_path
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


FACTS = f"WITH {V.FACTS_EV}"


def _pool_rows(keys):
    def run(spark, sf_dir):
        rows = graph.index(V.facts_ev(spark, sf_dir), keys, rows=16)
        whole = rows.groupBy(*keys).agg(F.sum("size").alias("size"))
        placed = rows.select(*keys, "first", F.posexplode("facts").alias("pos", "f")).select(*keys, (F.col("first") + F.col("pos")).cast("int").alias("pos"), F.col("f.line_no").alias("line_no"))
        return placed.join(whole, list(keys))

    return run


def _index_sql(keys: str) -> str:
    return f"""{FACTS} SELECT {keys}, count(*) OVER (PARTITION BY {keys}) AS size, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY d, line_no) - 1 AS INTEGER) AS pos, line_no FROM facts"""


query("idx_subj", _index_sql("s, r"))(_pool_rows(("s", "r")))
query("idx_obj", _index_sql("r, o"))(_pool_rows(("r", "o")))

INGEST = f"""{FACTS}, pair AS (SELECT s, o, min(line_no) AS pair_seq FROM facts GROUP BY ALL),
node AS (SELECT n, min(k) AS node_seq FROM (SELECT s AS n, 2 * line_no AS k FROM facts UNION ALL SELECT o, 2 * line_no + 1 FROM facts) GROUP BY n)
SELECT f.r, f.o, count(*) AS size, arg_min(line_no, (node_seq, pair_seq, line_no)) AS first_line, arg_max(line_no, (node_seq, pair_seq, line_no)) AS last_line
FROM facts f JOIN pair USING (s, o) JOIN node ON node.n = f.s GROUP BY f.r, f.o"""


@query("idx_obj_ingest", INGEST)
def idx_obj_ingest(spark, sf_dir):
    return graph.pool_summary(V.facts_ev(spark, sf_dir), ("r", "o"), order="ingest")


@query(
    "kg_stats",
    f"""{FACTS} SELECT count(*) AS edges, count(d) AS timed_edges, count(DISTINCT (s, r)) AS subj_keys, count(DISTINCT (r, o)) AS obj_keys,
 (SELECT count(DISTINCT n) FROM (SELECT s AS n FROM facts UNION ALL SELECT o FROM facts)) AS nodes FROM facts""",
)
def kg_stats(spark, sf_dir):
    return graph.statistics(V.facts_ev(spark, sf_dir))


def _own_pairs(spark, sf_dir):
    return V.facts_ev(spark, sf_dir).where("line_no % 37 = 0").select(F.col("line_no").alias("quid"), "s", "o", "r")


@query(
    "edge_lookup",
    f"""{FACTS} SELECT p.line_no AS quid, f.s, f.o, f.r, f.d, f.line_no, CAST(row_number() OVER (PARTITION BY p.line_no ORDER BY f.line_no) AS INTEGER) AS pos
 FROM facts p JOIN facts f ON f.s = p.s AND f.o = p.o WHERE p.line_no % 37 = 0""",
)
def edge_lookup(spark, sf_dir):
    return graph.edges_between(_own_pairs(spark, sf_dir).select("quid", "s", "o"), V.facts_ev(spark, sf_dir))


@query("edge_lookup_rel", f"{FACTS} SELECT p.line_no AS quid, f.s, f.r, f.o, f.d, f.line_no FROM facts p JOIN facts f ON f.s = p.s AND f.o = p.o AND f.r = p.r WHERE p.line_no % 37 = 0")
def edge_lookup_rel(spark, sf_dir):
    return graph.edges_with_relation(_own_pairs(spark, sf_dir), V.facts_ev(spark, sf_dir))


POOLS = f"""{V.BASE} SELECT qc.quid, qc.rel AS r, coalesce(f.s, qc.s) AS s, f.o, f.d, f.line_no FROM qc LEFT JOIN facts f ON f.s = qc.s AND f.r = qc.rel WHERE qc.s IS NOT NULL AND qc.o IS NULL
 UNION ALL SELECT qc.quid, qc.rel, f.s, coalesce(f.o, qc.o), f.d, f.line_no FROM qc LEFT JOIN facts f ON f.o = qc.o AND f.r = qc.rel WHERE qc.o IS NOT NULL AND qc.s IS NULL"""


@query("pool_lookup", POOLS)
def pool_lookup(spark, sf_dir):
    q = _asked(spark, sf_dir).select("quid", "s", "o", F.col("rel").alias("r"))
    return graph.pools(q, V.facts_ev(spark, sf_dir)).select("quid", "r", "s", "o", "d", "line_no")


@query("pool_lookup_stored", POOLS)
def pool_lookup_stored(spark, sf_dir):
    """The same from a graph stored in buckets, with pools above 64 facts in parts."""
    path = scratch_path(spark)
    fact_store.write_fact_store(V.facts_ev(spark, sf_dir), path, buckets=16, pool_rows=64)
    q = _asked(spark, sf_dir).select("quid", "s", "o", F.col("rel").alias("r"))
    return fact_store.stored_pools(q, path).select("quid", "r", "s", "o", "d", "line_no")


@query("fact_render", f"{FACTS} SELECT line_no, concat_ws(chr(9), s, r, o, CAST(d AS VARCHAR)) AS fact FROM facts")
def fact_render(spark, sf_dir):
    return V.facts_ev(spark, sf_dir).select("line_no", render_fact(F.col("s"), F.col("r"), F.col("o"), F.col("d")).alias("fact"))


# Cue graph ------------------------------------------------------------------------------------------


def _cue_sql(mode: str) -> str:
    center, end = ("o", "s") if mode == "obj" else ("s", "o")
    return f"""{FACTS}, t AS (SELECT *, strftime(d, '%Y-%m-%dT%H:%M:%S') AS t, concat_ws(chr(9), s, r, o, CAST(d AS VARCHAR)) AS fact FROM facts),
 run AS (SELECT {center} AS center, r AS relation, {end} AS src, lead({end}) OVER w AS dst, t AS time_1, lead(t) OVER w AS time_2, fact AS fact_1, lead(fact) OVER w AS fact_2,
  first_value((d, line_no)) OVER w AS g, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY {center}, r ORDER BY d, line_no)),
 after_ AS (SELECT src, dst, concat_ws('_', relation, time_1, time_2) AS edge_key, 'after' AS cue, relation, time_1, time_2, fact_1, fact_2, center, '{mode}' AS mode, g, place, 0 AS side FROM run WHERE time_2 IS NOT NULL),
 before_ AS (SELECT dst AS src, src AS dst, concat_ws('_', relation, time_2, time_1) AS edge_key, 'before' AS cue, relation, time_2 AS time_1, time_1 AS time_2, fact_2 AS fact_1, fact_1 AS fact_2, center, mode, g, place, 1 AS side FROM after_)"""


_CUE_COLUMNS = "src, dst, edge_key, cue, relation, time_1, time_2, fact_1, fact_2, center, mode"


def _cue(mode: str, mirrored: bool):
    def run(spark, sf_dir):
        edges = cue.after_edges(V.facts_ev(spark, sf_dir), mode)
        return (cue.before_edges(edges) if mirrored else edges).drop("write_seq")

    return run


for _mode in ("obj", "subj"):
    query(f"cue_after_{_mode}", f"{_cue_sql(_mode)} SELECT {_CUE_COLUMNS} FROM after_")(_cue(_mode, False))
    query(f"cue_before_{_mode}", f"{_cue_sql(_mode)} SELECT {_CUE_COLUMNS} FROM before_")(_cue(_mode, True))


@query(
    "cue_dedup",
    f"""{_cue_sql("subj")}, both_ AS (SELECT * FROM after_ UNION ALL SELECT * FROM before_),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_key ORDER BY g DESC, place DESC, side DESC, center DESC) AS k FROM both_) SELECT {_CUE_COLUMNS} FROM ranked WHERE k = 1""",
)
def cue_dedup(spark, sf_dir):
    return cue.cue_graph(V.facts_ev(spark, sf_dir), "subj")


# Retrieval ------------------------------------------------------------------------------------------


def _asked(spark, sf_dir):
    return retrieve.fan_out(V.questions(spark, sf_dir), V.candidates(spark, sf_dir))


POOL = f"""{V.BASE},
pool AS (SELECT qc.*, f.line_no, f.s AS fs, f.o AS fo, f.d AS fd FROM qc JOIN facts f ON f.s = qc.s AND f.r = qc.rel WHERE qc.o IS NULL
 UNION ALL SELECT qc.*, f.line_no, f.s, f.o, f.d FROM qc JOIN facts f ON f.o = qc.o AND f.r = qc.rel WHERE qc.s IS NULL),
anchor AS (SELECT qc.quid, qc.rel, coalesce(qc.s, qc.ref) AS a_s, coalesce(qc.o, qc.ref) AS a_o, max(f.d) AS a_d FROM qc JOIN facts f
 ON f.s = coalesce(qc.s, qc.ref) AND f.o = coalesce(qc.o, qc.ref) AND f.r = qc.rel WHERE qc.s IS NULL OR qc.o IS NULL GROUP BY ALL),
{V.ENTITIES},
bounded AS (SELECT qc.quid, qc.rel, t AS boundary, NULL AS a_s, NULL AS a_o, CAST(NULL AS DATE) AS a_d FROM qc WHERE t IS NOT NULL
 UNION ALL SELECT qc.quid, qc.rel, a_d, a_s, a_o, a_d FROM qc JOIN anchor USING (quid, rel) WHERE t IS NULL AND ref IN (SELECT name FROM ents))"""


def _ret_sql(source: str, order: str = "fd, line_no", limit: str = "", kind: str = "retrieved") -> str:
    return f"""SELECT quid, cand_rank, rel, '{kind}' AS kind, CAST(row_number() OVER (PARTITION BY quid, rel ORDER BY {order}) AS INTEGER) AS pos, fs AS s, rel AS r, fo AS o, fd AS d FROM ({source}) {limit}"""


_TRIPLE = "SELECT qc.*, f.line_no, f.s AS fs, f.o AS fo, f.d AS fd FROM qc JOIN facts f ON f.s = qc.s AND f.o = qc.o AND f.r = qc.rel"
_AT = "date_trunc(level, fd) = date_trunc(level, {})"

query("ret_equal_time", f"{POOL} " + _ret_sql(f"{_TRIPLE} WHERE qtype = 'equal' AND answer_type = 'time'", "line_no"))(lambda s, d: retrieve.equal_time(_asked(s, d), V.facts_ev(s, d)))


def _equal(side: str):
    def run(spark, sf_dir):
        return retrieve.equal_entity(_asked(spark, sf_dir).where(f"{side} is not null"), V.facts_ev(spark, sf_dir))

    return run


for _side, _key in (("s", "subj"), ("o", "obj")):
    query(f"ret_equal_{_key}", f"{POOL} " + _ret_sql(f"SELECT * FROM pool WHERE qtype = 'equal' AND answer_type = 'entity' AND {_side} IS NOT NULL AND {_AT.format('t')}"))(_equal(_side))


@query(
    "ret_equal_multi_same",
    f"""{POOL}, same AS (SELECT pool.*, a_d FROM pool JOIN anchor USING (quid, rel) WHERE qtype = 'equal_multi' AND word = 'the same')
 {_ret_sql(f"SELECT * FROM same WHERE {_AT.format('a_d')}")} UNION ALL
 SELECT quid, cand_rank, rel, 'qfact', 1, a_s, rel, a_o, a_d FROM qc JOIN anchor USING (quid, rel) WHERE qtype = 'equal_multi' AND word = 'the same'""",
)
def ret_equal_multi_same(spark, sf_dir):
    found, anchor = retrieve.equal_multi_same(_asked(spark, sf_dir), V.facts_ev(spark, sf_dir))
    return found.unionByName(anchor)


for _word, _last in (("first", False), ("last", True)):
    query(
        f"ret_equal_multi_{_word}",
        f"{POOL} " + _ret_sql(f"SELECT * FROM pool WHERE qtype = 'equal_multi' AND word = '{_word}' AND {_AT.format('t')}", "fd DESC, line_no DESC" if _last else "fd, line_no", "QUALIFY pos = 1"),
    )(lambda s, d, last=_last: retrieve.equal_multi_end(_asked(s, d), V.facts_ev(s, d), last))


def _end_sql(source: str) -> str:
    return _ret_sql(f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY quid, rel ORDER BY CASE WHEN word = 'first' THEN fd - DATE '1970-01-01' ELSE DATE '1970-01-01' - fd END) AS rk FROM ({source})) WHERE rk = 1")


query("ret_first_last_time", f"{POOL} " + _end_sql(f"{_TRIPLE} WHERE qtype = 'first_last' AND answer_type = 'time'"))(lambda s, d: retrieve.first_last_time(_asked(s, d), V.facts_ev(s, d)))
for _word in ("first", "last"):
    query(f"ret_{_word}", f"{POOL} " + _end_sql(f"SELECT * FROM pool WHERE qtype = 'first_last' AND answer_type = 'entity' AND word = '{_word}'"))(
        lambda s, d, w=_word: retrieve.first_last_entity(_asked(s, d).where(f"cue = '{w}'"), V.facts_ev(s, d))
    )


def _bounded(spark, sf_dir, kinds: str):
    q = _asked(spark, sf_dir).where(f"qtype in ({kinds})")
    return retrieve.with_boundary(q, V.facts_ev(spark, sf_dir), V.entities(spark, sf_dir))


@query("boundary_resolve", f"{POOL} SELECT quid, rel, CAST(boundary AS DATE) AS boundary, a_s, a_o, a_d FROM bounded JOIN qc USING (quid, rel) WHERE qtype IN ('before_after', 'before_last', 'after_first')")
def boundary_resolve(spark, sf_dir):
    return _bounded(spark, sf_dir, "'before_after', 'before_last', 'after_first'").select("quid", "rel", "boundary", "a_s", "a_o", "a_d")


_DIRECTED = "SELECT pool.*, boundary FROM pool JOIN bounded USING (quid, rel) WHERE qtype = '{}' AND date_trunc(level, fd) {} date_trunc(level, boundary)"
for _word, _op in (("before", "<"), ("after", ">")):
    query(f"ret_{_word}", f"{POOL} " + _ret_sql(_DIRECTED.format("before_after", _op) + f" AND word = '{_word}'", limit="QUALIFY pos <= 10"))(
        lambda s, d, w=_word: retrieve.before_after(_bounded(s, d, "'before_after'").where(f"cue = '{w}'"), V.facts_ev(s, d))
    )
for _kind, _op, _dir in (("before_last", "<", "DESC"), ("after_first", ">", "ASC")):
    query(
        f"ret_{_kind}",
        f"{POOL} " + _ret_sql(f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY quid, rel ORDER BY fd {_dir}) AS rk FROM ({_DIRECTED.format(_kind, _op)})) WHERE rk = 1"),
    )(lambda s, d, k=_kind: retrieve.strict_as_of(_bounded(s, d, f"'{k}'"), V.facts_ev(s, d)))


@query("route_counts", f"{V.BASE} SELECT qtype AS route, count(*) AS n FROM q GROUP BY qtype")
def route_counts(spark, sf_dir):
    return retrieve.route_counts(V.questions(spark, sf_dir))


_INVALID = "((s IS NOT NULL AND s NOT IN (SELECT name FROM ents)) OR (o IS NOT NULL AND o NOT IN (SELECT name FROM ents)))"


@query("invalid_entity_anti", f"{V.BASE}, {V.ENTITIES} SELECT quid, question FROM q WHERE {_INVALID}")
def invalid_entity_anti(spark, sf_dir):
    return retrieve.invalid_questions(V.questions(spark, sf_dir), V.entities(spark, sf_dir))


def retrieved(spark, sf_dir, order: str = "time"):
    return retrieve.retrieve(V.questions(spark, sf_dir), V.candidates(spark, sf_dir), V.facts_ev(spark, sf_dir), V.entities(spark, sf_dir), order)


def counted(spark, sf_dir):
    return retrieve.retrieve_counted(V.questions(spark, sf_dir), V.candidates(spark, sf_dir), V.facts_ev(spark, sf_dir), V.entities(spark, sf_dir))


RETRIEVED = f"""{POOL}, ok AS (SELECT quid FROM q WHERE NOT {_INVALID}),
hits AS ({_ret_sql(f"{_TRIPLE} WHERE qtype = 'equal' AND answer_type = 'time'", "line_no")}
 UNION ALL {_ret_sql(f"SELECT * FROM pool WHERE qtype = 'equal' AND answer_type = 'entity' AND {_AT.format('t')}")}
 UNION ALL {_ret_sql(f"SELECT pool.*, a_d FROM pool JOIN anchor USING (quid, rel) WHERE qtype = 'equal_multi' AND word = 'the same' AND {_AT.format('a_d')}")}
 UNION ALL SELECT quid, cand_rank, rel, 'qfact', 1, a_s, rel, a_o, a_d FROM qc JOIN anchor USING (quid, rel) WHERE qtype = 'equal_multi' AND word = 'the same'
 UNION ALL {_ret_sql(f"SELECT * FROM pool WHERE qtype = 'equal_multi' AND word = 'first' AND {_AT.format('t')}", limit="QUALIFY pos = 1")}
 UNION ALL {_ret_sql(f"SELECT * FROM pool WHERE qtype = 'equal_multi' AND word = 'last' AND {_AT.format('t')}", "fd DESC, line_no DESC", "QUALIFY pos = 1")}
 UNION ALL {_end_sql(f"{_TRIPLE} WHERE qtype = 'first_last' AND answer_type = 'time'")}
 UNION ALL {_end_sql("SELECT * FROM pool WHERE qtype = 'first_last' AND answer_type = 'entity'")}
 UNION ALL {_ret_sql(_DIRECTED.format("before_after", "<") + " AND word = 'before'", limit="QUALIFY pos <= 10")}
 UNION ALL {_ret_sql(_DIRECTED.format("before_after", ">") + " AND word = 'after'", limit="QUALIFY pos <= 10")}
 UNION ALL {_ret_sql(f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY quid, rel ORDER BY fd DESC) AS rk FROM ({_DIRECTED.format('before_last', '<')})) WHERE rk = 1")}
 UNION ALL {_ret_sql(f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY quid, rel ORDER BY fd) AS rk FROM ({_DIRECTED.format('after_first', '>')})) WHERE rk = 1")}
 UNION ALL SELECT quid, cand_rank, rel, 'qfact', 1, a_s, rel, a_o, a_d FROM bounded JOIN qc USING (quid, rel) WHERE a_d IS NOT NULL AND qtype IN ('before_after', 'before_last', 'after_first')),
ret AS (SELECT * FROM hits WHERE quid IN (SELECT quid FROM ok))"""

query("ret_all", f"{RETRIEVED} SELECT * FROM ret")(retrieved)


@query("ret_empty", f"{RETRIEVED} SELECT quid, question FROM q WHERE quid NOT IN (SELECT quid FROM ret WHERE kind = 'retrieved')")
def ret_empty(spark, sf_dir):
    return retrieve.empty_questions(V.questions(spark, sf_dir), retrieved(spark, sf_dir))


@query(
    "ret_nested",
    f"""{RETRIEVED}, keyed AS (SELECT quid, rel, min(cand_rank) AS cand_rank FROM qc GROUP BY ALL)
 SELECT keyed.quid, keyed.rel, CAST(count(*) FILTER (WHERE kind = 'qfact') AS INTEGER) AS n_qfact, CAST(count(*) FILTER (WHERE kind = 'retrieved') AS INTEGER) AS n_retrieved,
 coalesce(string_agg(concat_ws(chr(9), s, r, o, coalesce(CAST(d AS VARCHAR), 'None')), ';' ORDER BY pos) FILTER (WHERE kind = 'retrieved'), '') AS facts
 FROM keyed LEFT JOIN ret ON ret.quid = keyed.quid AND ret.rel = keyed.rel GROUP BY keyed.quid, keyed.rel""",
)
def ret_nested(spark, sf_dir):
    """The nested result, its maps laid flat: one row a question and relation."""
    n = retrieve.nested(V.questions(spark, sf_dir), V.candidates(spark, sf_dir), retrieved(spark, sf_dir))
    flat = n.select("quid", "qfact", F.explode("retrieved").alias("rel", "facts"))
    return flat.select("quid", "rel", F.size(F.try_element_at("qfact", F.col("rel"))).alias("n_qfact"), F.size("facts").alias("n_retrieved"), F.array_join("facts", ";").alias("facts"))
