"""Queries of evidence filtering, selection, answering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, evaluate, evidence
from . import views as V
from .retrieval_queries import RETRIEVED, counted, retrieved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Conversion, cue, anchor ----------------------------------------------------------------------------


@query("global_entities", f"{V.BASE} SELECT DISTINCT lower(name) AS name FROM (SELECT own_s AS name FROM q UNION ALL SELECT own_o FROM q)")
def global_entities(spark, sf_dir):
    return evidence.global_entities(V.questions(spark, sf_dir))


@query("semantic_to_tab", f"WITH {V.FACTS_EV} SELECT line_no // 100 AS quid, CAST(line_no % 100 AS INTEGER) AS pos, s, r, o, d FROM facts")
def semantic_to_tab(spark, sf_dir):
    f = V.facts_ev(spark, sf_dir)
    hits = f.select(F.expr("line_no div 100").alias("quid"), (F.col("line_no") % 100).cast("int").alias("rank"), F.col("line_no").alias("fact_id"))
    return evidence.facts_of_ids(hits, f)


@query(
    "semantic_to_tab_text",
    """WITH n AS (SELECT c_custkey AS quid, c_custkey % 4 AS k, n_name AS a, r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT quid, 1 AS pos, CASE WHEN k = 3 THEN 'Someone' ELSE a END AS s, CASE k WHEN 3 THEN 'sold to the' ELSE 'sold to' END AS r, CASE k WHEN 0 THEN b WHEN 1 THEN upper(b) WHEN 2 THEN 'Bob (trader)' ELSE 'man' END AS o, DATE '2015-03-04' AS d FROM n""",
)
def semantic_to_tab_text(spark, sf_dir):
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    c = V.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k, tail = F.col("c_custkey") % 4, F.lit(" in 2015-03-04 ")
    text = (
        F.when(k == 3, F.concat(F.lit("Someone sold to the man"), tail))
        .when(k == 2, F.concat("n_name", F.lit(" sold to Bob (trader)"), tail))
        .otherwise(F.concat("n_name", F.lit(" sold to "), F.when(k == 0, F.col("r_name")).otherwise(F.upper("r_name")), tail))
    )
    listed = F.array(F.col("n_name"), F.when(k == 0, F.col("r_name")), F.lit("None"))
    rows = c.select(F.col("c_custkey").alias("quid"), F.lit(1).alias("pos"), text.alias("fact"), listed.alias("entities"))
    return evidence.facts_of_sentences(rows, r.select(F.lower("r_name").alias("name")))


def _phrases(spark, sf_dir):
    values = ["before", "last before", " In the same month as ", "for the first time", "LAST", "None", "in 2012", "14 October 2015", "whenever", "after"]
    s = V.table(spark, sf_dir, "supplier")
    word = F.get(F.array(F.lit("before"), F.lit("after"), F.lit("beforehand")), (F.col("s_suppkey") % 3).cast("int"))
    return s.select(
        F.col("s_suppkey").alias("quid"), F.get(F.array(*[F.lit(v) for v in values]), (F.col("s_suppkey") % 10).cast("int")).alias("raw"),
        F.get(F.array(F.lit("equal"), F.lit("before_after"), F.lit("other"), F.lit("first_last")), (F.col("s_suppkey") % 4).cast("int")).alias("qtype"),
        F.concat(F.lit("What came "), word, F.lit(" the first war")).alias("question"),
    )


PHRASES = """WITH p AS (SELECT s_suppkey AS quid, s_suppkey % 10 AS k, ['equal','before_after','other','first_last'][s_suppkey % 4 + 1] AS qtype, ['before','after','beforehand'][s_suppkey % 3 + 1] AS w FROM supplier),
c AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'before' WHEN k IN (2, 6, 7) THEN 'same' WHEN k = 3 THEN 'first' WHEN k = 4 THEN 'last' WHEN k = 9 THEN 'after' END AS cue FROM p)"""


@query("cue_normalise", f"{PHRASES} SELECT quid, cue FROM c")
def cue_normalise(spark, sf_dir):
    return _phrases(spark, sf_dir).select("quid", X.cue_of_phrase(F.col("raw")).alias("cue"))


@query(
    "cue_infer",
    f"""{PHRASES} SELECT quid, coalesce(cue, CASE qtype WHEN 'equal' THEN 'same' WHEN 'before_after' THEN CASE WHEN w = 'after' THEN 'after' ELSE 'before' END WHEN 'first_last' THEN 'first'
 ELSE CASE w WHEN 'beforehand' THEN 'first' ELSE w END END) AS cue FROM c""",
)
def cue_infer(spark, sf_dir):
    return _phrases(spark, sf_dir).select("quid", X.infer_cue(F.col("raw"), F.col("qtype"), F.col("question")).alias("cue"))


@query(
    "anchor_from_entity",
    f"""{V.POOLS} SELECT quid, CASE WHEN cue IN ('after', 'first', 'same') THEN min(d) ELSE max(d) END AS anchor FROM pool JOIN cues USING (quid)
 WHERE contains(lower(o), 'brand#' || CAST(1 + quid % 5 AS VARCHAR)) OR contains(lower(s), 'brand#' || CAST(1 + quid % 5 AS VARCHAR)) GROUP BY quid, cue""",
)
def anchor_from_entity(spark, sf_dir):
    refs = V.pool_cues(spark, sf_dir).select("quid", F.concat(F.lit("bRand#"), F.col("quid") % 5 + 1).alias("ref"), "cue")
    return evidence.anchor_of_reference(refs, V.pools(spark, sf_dir))


@query(
    "anchor_from_regex",
    f"""{V.POOLS} SELECT quid, CASE WHEN cue IN ('after', 'first', 'same') THEN min(d) ELSE max(d) END AS anchor FROM pool JOIN cues USING (quid)
 WHERE cue IS NOT NULL AND contains(o, 'Brand#' || CAST(1 + quid % 5 AS VARCHAR)) GROUP BY quid, cue""",
)
def anchor_from_regex(spark, sf_dir):
    q = V.pool_cues(spark, sf_dir).where("cue is not null")
    asked = q.withColumn("question", F.concat(F.lit("What happened "), "cue", F.lit(" Brandx"), F.lit(", really")))
    refs = asked.select("quid", F.regexp_replace(X.question_reference(F.col("question")), "x$", F.concat(F.lit("#"), F.col("quid") % 5 + 1)).alias("ref"), "cue")
    return evidence.anchor_of_reference(refs, V.pools(spark, sf_dir))


@query(
    "anchor_infer",
    f"""{V.POOLS}, refd AS (SELECT quid, CASE WHEN coalesce(cue, 'same') IN ('after', 'first', 'same') THEN min(d) ELSE max(d) END AS a FROM pool JOIN cues USING (quid)
  WHERE contains(o, 'Brand#' || CAST(1 + quid % 5 AS VARCHAR)) GROUP BY quid, cue)
 SELECT quid, coalesce(cue, 'same') AS cue, CASE quid % 4 WHEN 0 THEN DATE '1996-05-01' WHEN 1 THEN coalesce(a, DATE '1994-01-01') WHEN 2 THEN CASE WHEN quid % 8 = 2 THEN DATE '1993-02-07' ELSE DATE '1994-01-01' END
  ELSE DATE '1994-01-01' END AS anchor FROM cues LEFT JOIN refd USING (quid)""",
)
def anchor_infer(spark, sf_dir):
    q = V.pool_cues(spark, sf_dir)
    k = F.col("quid") % 4
    questions = q.select("quid", F.lit("Who sold it in 1994?").alias("question"), F.lit("equal").alias("qtype"))
    # In the fourth kind the phrase holds a date of its own, which also makes it "same".
    phrase = F.when(F.col("quid") % 8 == 2, F.lit("7 February 1993")).otherwise(F.coalesce("cue", F.lit("None")))
    lookup = q.select(
        "quid", phrase.alias("cue"), F.when(k == 0, F.array(F.lit("soon"), F.lit("1996-05"))).otherwise(F.array().cast("array<string>")).alias("time"),
        F.when(k == 1, F.concat(F.lit("Brand#"), F.col("quid") % 5 + 1)).otherwise(F.lit("None")).alias("reference_target"),
    )
    out = evidence.infer_cue_and_anchor(questions, lookup, V.pools(spark, sf_dir))
    return out.join(q.select("quid", F.col("cue").alias("own")), "quid").select("quid", F.when(F.col("quid") % 8 == 2, F.coalesce("own", F.lit("same"))).otherwise(F.col("cue")).alias("cue"), "anchor")


# Trigger, dedup, selection --------------------------------------------------------------------------

TRIGGER = f"""{V.POOLS}, score AS (SELECT quid, count(*) AS n, count(DISTINCT (s, r, o)) AS signatures FROM pool GROUP BY quid),
gate AS (SELECT *, 0.5::DOUBLE * (n / 30.0::DOUBLE) + 0.5::DOUBLE * (1 - CAST(signatures AS DOUBLE) / n) AS score FROM score)"""


@query("trigger_score", f"{TRIGGER} SELECT quid, n, signatures, round(score, 6) AS score FROM gate")
def trigger_score(spark, sf_dir):
    return evidence.trigger_score(V.pools(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("trigger_gate", f"{TRIGGER} SELECT quid, n, score > 0.75 AS triggered FROM gate")
def trigger_gate(spark, sf_dir):
    return evidence.trigger_gate(V.pools(spark, sf_dir)).select("quid", "n", "triggered")


@query("legacy_triggered", f"{TRIGGER} SELECT quid, n FROM gate WHERE score > 0.75")
def legacy_triggered(spark, sf_dir):
    return evidence.triggered_only(V.pools(spark, sf_dir)).select("quid", "n")


_OK = "(anchor IS NULL OR CASE cue WHEN 'after' THEN d > anchor WHEN 'before' THEN d < anchor WHEN 'same' THEN d = anchor ELSE true END)"
PREDEDUP = f"""kept AS (SELECT quid, s, r, o, CASE WHEN cue IN ('after', 'first') OR cue IS NULL THEN arg_min((pos, d), (d, pos)) ELSE arg_max((pos, d), (d, pos)) END AS x
 FROM pool JOIN cues USING (quid) WHERE {_OK} GROUP BY quid, s, r, o, cue),
 pre AS (SELECT quid, x[1] AS pos, s, r, o, x[2] AS d FROM kept)"""


@query("prededup_sro", f"{V.POOLS}, {PREDEDUP} SELECT * FROM pre")
def prededup_sro(spark, sf_dir):
    return evidence.prededup(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir)).drop("class_pos")


@query("prededup_fallback", f"{V.POOLS}, {PREDEDUP} SELECT * FROM pre UNION ALL SELECT * FROM pool WHERE NOT EXISTS (FROM pre WHERE pre.quid = pool.quid)")
def prededup_fallback(spark, sf_dir):
    return evidence.prededup_or_all(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir))


@query("ordinal_rank", f"{V.POOLS} SELECT p.quid, p.pos, CASE cue WHEN 'first' THEN upto - 1 WHEN 'last' THEN n - upto END AS ordinal FROM (SELECT *, count(*) OVER (PARTITION BY quid, s, r, o) AS n, (SELECT count(*) FROM pool z WHERE z.quid = y.quid AND z.s = y.s AND z.r = y.r AND z.o = y.o AND z.d <= y.d) AS upto FROM pool y) p JOIN cues USING (quid)")
def ordinal_rank(spark, sf_dir):
    return evidence.ordinal_rank(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir)).select("quid", "pos", "ordinal")


def _stages(pool: str) -> str:
    """Stage 1 and 2 over a table of facts.  Equal days of a class collapse under every cue, as with a step of one day."""
    return f"""ranked AS (SELECT p.*, cue, anchor, target, row_number() OVER (PARTITION BY p.quid, s, r, o, d ORDER BY pos) AS k FROM {pool} p JOIN cues ON cues.quid = p.quid),
 fd AS (SELECT quid, pos, s, r, o, d, cue, anchor, target, CAST(row_number() OVER (PARTITION BY quid ORDER BY d, pos) AS INTEGER) AS out_pos FROM ranked WHERE k = 1),
 cov AS (SELECT * FROM fd WHERE {_OK}),
 broken AS (SELECT quid FROM cov GROUP BY quid HAVING count(*) > 1 AND bool_or(target IS NOT NULL AND r <> target)),
 fc AS (SELECT * FROM cov WHERE NOT EXISTS (FROM broken WHERE broken.quid = cov.quid) UNION ALL SELECT * FROM fd WHERE quid IN (SELECT quid FROM broken))"""


@query("stage1_dedup", f"{V.POOLS}, {_stages('pool')} SELECT quid, pos, s, r, o, d, out_pos FROM fd")
def stage1_dedup(spark, sf_dir):
    return evidence.stage1(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir)).select("quid", "pos", "s", "r", "o", "d", "out_pos")


@query("cue_coverage", f"{V.POOLS}, {_stages('pool')} SELECT quid, pos, out_pos FROM cov")
def cue_coverage(spark, sf_dir):
    return evidence.covered(evidence.stage1(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir))).select("quid", "pos", "out_pos")


@query("stage2_select", f"{V.POOLS}, {_stages('pool')} SELECT quid, pos, s, r, o, d, out_pos FROM fc")
def stage2_select(spark, sf_dir):
    cues = V.pool_cues(spark, sf_dir)
    return evidence.stage2(evidence.stage1(V.pools(spark, sf_dir), cues), cues.select("quid", "target")).select("quid", "pos", "s", "r", "o", "d", "out_pos")


@query("chain_connected", f"{V.POOLS}, {_stages('pool')} SELECT quid, quid NOT IN (SELECT quid FROM broken) AS connected FROM cov GROUP BY quid")
def chain_connected(spark, sf_dir):
    cues = V.pool_cues(spark, sf_dir)
    return evidence.connected(evidence.covered(evidence.stage1(V.pools(spark, sf_dir), cues)), cues.select("quid", "target"))


STATS = """stats AS (SELECT n.quid, n_input, coalesce(n_dedup, 0) AS n_dedup, coalesce(n_select, 0) AS n_select FROM (SELECT quid, count(*) AS n_input FROM {pool} GROUP BY quid) n
 LEFT JOIN (SELECT quid, count(*) AS n_dedup FROM fd GROUP BY quid) USING (quid) LEFT JOIN (SELECT quid, count(*) AS n_select FROM fc GROUP BY quid) USING (quid))"""


@query(
    "csef_stats",
    f"""{V.POOLS}, {_stages('pool')}, {STATS.format(pool='pool')} SELECT *, CASE WHEN n_select > 0 THEN round(CAST(n_dedup AS DOUBLE) / n_select, 6) END AS ratio,
 coalesce(n_select > 0 AND CAST(n_dedup AS DOUBLE) / n_select > 3, false) AS verifier_triggered, CASE WHEN n_select > 0 AND CAST(n_dedup AS DOUBLE) / n_select > 3 THEN quid % 2 = 0 END AS verifier_accepted FROM stats""",
)
def csef_stats(spark, sf_dir):
    cues = V.pool_cues(spark, sf_dir)
    _, stats = evidence.select_evidence(V.pools(spark, sf_dir), cues, targets=cues.select("quid", "target"), verdicts=cues.select("quid", (F.col("quid") % 2 == 0).alias("accepted")))
    return stats.withColumn("ratio", F.round("ratio", 6))


@query(
    "csef_batch",
    f"""{V.POOLS}, {_stages('pool')}, {STATS.format(pool='pool')}, refused AS (SELECT quid FROM stats WHERE n_select > 0 AND CAST(n_dedup AS DOUBLE) / n_select > 3)
 SELECT quid, out_pos, s, r, o, d FROM fc WHERE NOT EXISTS (FROM refused WHERE refused.quid = fc.quid) UNION ALL SELECT quid, out_pos, s, r, o, d FROM fd WHERE quid IN (SELECT quid FROM refused)""",
)
def csef_batch(spark, sf_dir):
    cues = V.pool_cues(spark, sf_dir)
    final, _ = evidence.select_evidence(V.pools(spark, sf_dir), cues, targets=cues.select("quid", "target"))
    return final.select("quid", "out_pos", "s", "r", "o", "d")


FILTERED = f"""{TRIGGER}, {PREDEDUP}, hot AS (SELECT * FROM pre UNION ALL SELECT * FROM pool WHERE NOT EXISTS (FROM pre WHERE pre.quid = pool.quid)),
 live AS (SELECT hot.* FROM hot JOIN gate USING (quid) WHERE gate.score > 0.75), {_stages('live').replace('SELECT p.*, cue, anchor, target,', 'SELECT p.*, cue, anchor, CAST(NULL AS VARCHAR) AS target,')},
 {STATS.format(pool='live')}, refused AS (SELECT quid FROM stats WHERE n_select > 0 AND CAST(n_dedup AS DOUBLE) / n_select > 3),
 final AS (SELECT quid, out_pos AS pos, s, r, o, d FROM fc WHERE NOT EXISTS (FROM refused WHERE refused.quid = fc.quid) UNION ALL SELECT quid, out_pos, s, r, o, d FROM fd WHERE quid IN (SELECT quid FROM refused)
  UNION ALL SELECT pool.quid, pool.pos, s, r, o, d FROM pool JOIN gate USING (quid) WHERE gate.score <= 0.75)"""


@query("evidence_filter", f"{FILTERED} SELECT * FROM final")
def evidence_filter(spark, sf_dir):
    return evidence.filter_evidence(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir))[0]


@query(
    "evidence_counts",
    f"""{FILTERED} SELECT quid, CAST(n AS INTEGER) AS original_fact_num, CAST(coalesce(m, 0) AS INTEGER) AS final_fact_num, score > 0.75 AS triggered, n <> coalesce(m, 0) AS filtered
 FROM gate LEFT JOIN (SELECT quid, count(*) AS m FROM final GROUP BY quid) USING (quid)""",
)
def evidence_counts(spark, sf_dir):
    return evidence.filter_evidence(V.pools(spark, sf_dir), V.pool_cues(spark, sf_dir))[1]


@query("collect_graph_facts", f"{RETRIEVED} SELECT quid, CAST(row_number() OVER (PARTITION BY quid ORDER BY cand_rank, CASE kind WHEN 'qfact' THEN 0 ELSE 1 END, pos) AS INTEGER) AS pos, s, r, o, d FROM ret")
def collect_graph_facts(spark, sf_dir):
    return evidence.collect_graph_facts(counted(spark, sf_dir)[0])


def _two_sets(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("quid"))
    a = F.transform(F.sequence(F.lit(1), F.col("quid") % 4 + 1), lambda i: F.concat(F.lit("The X"), i))
    b = F.transform(F.sequence(F.lit(1), F.col("quid") % 3 + 1), lambda i: F.concat(F.lit("x"), i, F.lit("!")))
    return s.select("quid", a.alias("a"), b.alias("b"))


@query("mutual_entail", "SELECT s_suppkey AS quid, s_suppkey % 4 = s_suppkey % 3 AS accepted FROM supplier")
def mutual_entail(spark, sf_dir):
    plain = _two_sets(spark, sf_dir).select("quid", F.transform("a", X.normalise_answer).alias("a"), F.transform("b", X.normalise_answer).alias("b"))
    return evidence.mutual_entailment(plain)


@query(
    "answers_equal",
    """WITH two AS (SELECT s_suppkey AS quid, range(1, s_suppkey % 4 + 2) AS a, list_transform(range(1, s_suppkey % 3 + 2), lambda i: i + s_suppkey % 5) AS b FROM supplier)
 SELECT quid, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS equal FROM two""",
)
def answers_equal(spark, sf_dir):
    moved = F.transform(F.sequence(F.lit(1), F.col("quid") % 3 + 1), lambda i: F.concat(F.lit("x"), i + F.col("quid") % 5, F.lit("!")))
    return evidence.answers_equal(_two_sets(spark, sf_dir).withColumn("b", moved)).select("quid", "equal")


# Answering ------------------------------------------------------------------------------------------

_SENTENCE = "s || ' ' || r || ' ' || o || ' in ' || CAST(d AS VARCHAR)"
CASCADE = f"""{RETRIEVED}, sem AS (SELECT quid, 1 AS rank, 'semantic ' || own_s AS fact FROM q WHERE quid % 2 = 0), cau AS (SELECT quid, 1 AS pos, 'causal ' || own_o AS fact FROM q WHERE quid % 5 = 0),
 srcs AS (SELECT quid, CASE WHEN quid % 5 = 0 THEN 'causal' WHEN quid IN (SELECT quid FROM ret WHERE kind = 'retrieved') THEN 'graph' ELSE 'semantic' END AS source FROM q),
 used AS (SELECT quid, 0 AS c, 0 AS k, pos, fact, 'causal' AS source FROM cau UNION ALL SELECT quid, 0, 0, rank, fact, 'semantic' FROM sem
  UNION ALL SELECT quid, cand_rank, CASE kind WHEN 'qfact' THEN 0 ELSE 1 END, pos, {_SENTENCE}, 'graph' FROM ret),
 casc AS (SELECT used.quid, CAST(row_number() OVER (PARTITION BY used.quid ORDER BY c, k, pos) AS INTEGER) AS pos, fact, source FROM used JOIN srcs USING (quid, source))"""


def _cascade(spark, sf_dir):
    q = V.questions(spark, sf_dir)
    sem = q.where("quid % 2 = 0").select("quid", F.lit(1).alias("rank"), F.concat(F.lit("semantic "), F.get("entities", F.lit(0))).alias("fact"))
    cau = q.where("quid % 5 = 0").select("quid", F.lit(1).alias("pos"), F.concat(F.lit("causal "), F.get("entities", F.lit(1))).alias("fact"))
    graph, found = counted(spark, sf_dir)
    return answer.cascade(graph, sem, cau, found=found)


query("fact_cascade", f"{CASCADE} SELECT * FROM casc")(_cascade)


@query(
    "prompt_render",
    f"""{CASCADE} SELECT q.quid, 'Answer the question from the facts alone. Give every answer that ties, exact names, and times at the asked level, as JSON {{"answers": [...]}}.' || chr(10) || 'Question: ' || question || chr(10) || 'Facts: ' ||
 '[' || coalesce(string_agg('"' || fact || '"', ',' ORDER BY pos), '') || ']' AS prompt FROM q LEFT JOIN casc ON casc.quid = q.quid GROUP BY q.quid, question""",
)
def prompt_render(spark, sf_dir):
    return answer.prompts(V.questions(spark, sf_dir), _cascade(spark, sf_dir))


@query(
    "answer_parse",
    "SELECT s_suppkey AS quid, CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE 2 END AS n, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE s_name || '|y' END AS answers FROM supplier",
)
def answer_parse(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    body = F.concat(F.lit('{"answers": ["'), "s_name", F.lit('", "y"]}'))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("```"))).when(F.col("s_suppkey") % 3 == 1, body).otherwise(F.lit("oops"))
    out = answer.parse_answers(s.select(F.col("s_suppkey").alias("quid"), raw.alias("raw")))
    return out.select("quid", F.size("model_answer").alias("n"), F.array_join("model_answer", "|").alias("answers"))


EXTRACTED = f"""{RETRIEVED}, given AS (SELECT DISTINCT ret.quid, CASE WHEN answer_type = 'time' THEN substr(CAST(ret.d AS VARCHAR), 1, CASE level WHEN 'year' THEN 4 WHEN 'month' THEN 7 ELSE 10 END) WHEN q.s IS NOT NULL AND q.o IS NULL THEN ret.o ELSE ret.s END AS answer
 FROM ret JOIN q ON q.quid = ret.quid WHERE kind = 'retrieved'), ext AS (SELECT quid, CAST(row_number() OVER (PARTITION BY quid ORDER BY answer) AS INTEGER) AS pos, answer FROM given)"""


@query("answer_extract", f"{EXTRACTED} SELECT * FROM ext")
def answer_extract(spark, sf_dir):
    return answer.extract_answers(V.questions(spark, sf_dir), retrieved(spark, sf_dir).where("kind = 'retrieved'"))


# Evaluation -----------------------------------------------------------------------------------------


@query("eval_normalize", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) || ' ' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || ' old' AS text FROM part")
def eval_normalize(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), X.normalise_answer(F.concat(F.lit("The "), "p_name", F.lit(" (a  "), "p_brand", F.lit("), an OLD!"))).alias("text"))


@query("eval_match", "SELECT p_partkey AS id, contains(lower(p_type), lower(split_part(p_type, ' ', 1 + CAST(p_partkey % 3 AS INTEGER)))) AND p_partkey % 4 <> 0 AS hit FROM part")
def eval_match(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    word = F.expr("split_part(p_type, ' ', cast(1 + p_partkey % 3 as int))")
    gold = F.when(F.col("p_partkey") % 4 == 0, F.lit("zzz")).otherwise(F.concat(F.lit("the "), word, F.lit(".")))
    return p.select(F.col("p_partkey").alias("id"), X.answer_matches(F.col("p_type"), gold).alias("hit"))


@query("eval_pred_list", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS n, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|b' WHEN 1 THEN p_brand WHEN 2 THEN '[' || p_brand ELSE '' END AS joined FROM part")
def eval_pred_list(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(' ["'), "p_brand", F.lit('", "b"]'))).when(k == 1, F.col("p_brand")).when(k == 2, F.concat(F.lit("["), "p_brand"))
    x = evaluate.prediction_list(raw)
    return p.select(F.col("p_partkey").alias("id"), F.size(x).alias("n"), F.array_join(x, "|").alias("joined"))


def _predictions(spark, sf_dir):
    """Predictions of the questions: right, right in other words, right in second place, none."""
    q = V.questions(spark, sf_dir)
    a, k = F.get("answers", F.lit(0)), F.expr("quid div 37") % 4
    given = F.when(k == 0, F.array(a)).when(k == 1, F.array(F.concat(F.lit("The "), a, F.lit("!")))).when(k == 2, F.array(F.lit("nobody"), a)).otherwise(F.array().cast("array<string>"))
    return q.select("quid", "question", given.alias("model_answer"), "qtype", "qlabel", "answer_type", F.col("answers").alias("ground_truth"), "time_level")


def _hits_sql(k: int) -> str:
    return f"{V.BASE}, h AS (SELECT *, CASE WHEN (quid // 37) % 4 <= {k} THEN 1 ELSE 0 END AS hit FROM q)"


@query("eval_hit", f"{_hits_sql(1)} SELECT quid, hit AS hit_1, CASE WHEN (quid // 37) % 4 <= 2 THEN 1 ELSE 0 END AS hit_2 FROM h")
def eval_hit(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.select("quid", *[evaluate.hit_at(F.col("model_answer"), F.col("ground_truth"), k).alias(f"hit_{k}") for k in (1, 2)])


GROUPED = f"""{_hits_sql(1)}, g AS (SELECT 'overall' AS dimension, 'all' AS value, hit FROM h UNION ALL SELECT 'answer_type', answer_type, hit FROM h UNION ALL SELECT 'qlabel', qlabel, hit FROM h UNION ALL SELECT 'qtype', qtype, hit FROM h),
 t AS (SELECT dimension, value, CAST(sum(hit) AS BIGINT) AS hit, count(*) AS total FROM g GROUP BY ALL)"""


@query("eval_grouping_sets", f"{GROUPED} SELECT * FROM t")
def eval_grouping_sets(spark, sf_dir):
    return evaluate.grouped(_predictions(spark, sf_dir))


@query("eval_report", f"{GROUPED} SELECT *, round(100 * CAST(hit AS DOUBLE) / total, 2) AS percent FROM t")
def eval_report(spark, sf_dir):
    return evaluate.report(_predictions(spark, sf_dir))


@query("eval_wrong", f"{_hits_sql(1)} SELECT quid, question, qtype, qlabel, answer_type, level AS time_level FROM h WHERE hit = 0")
def eval_wrong(spark, sf_dir):
    return evaluate.wrong_cases(_predictions(spark, sf_dir)).drop("model_answer", "ground_truth")


@query(
    "answer_hits",
    f"""{EXTRACTED}, firsts AS (SELECT q.quid, qtype, CASE WHEN bool_or(contains(regexp_replace(lower(ext.answer), '[^a-z0-9 ]', '', 'g'), regexp_replace(lower(q.answer), '[^a-z0-9 ]', '', 'g'))) THEN 1 ELSE 0 END AS hit
 FROM q LEFT JOIN ext ON ext.quid = q.quid AND ext.pos = 1 GROUP BY ALL) SELECT qtype AS value, CAST(sum(hit) AS BIGINT) AS hit, count(*) AS total FROM firsts GROUP BY qtype""",
)
def answer_hits(spark, sf_dir):
    """From questions to Hit@1 with the extractive answerer."""
    q = V.questions(spark, sf_dir)
    p = answer.predictions(q, retrieved(spark, sf_dir).where("kind = 'retrieved'"), first=True)
    return evaluate.grouped(p).where("dimension = 'qtype'").select("value", "hit", "total")
