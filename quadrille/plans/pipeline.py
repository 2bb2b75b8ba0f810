"""The pipeline from questions to scores, and its command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.models import Generator, generate, with_rates
from ..functions.temporal import render_sentence
from ..operators import answer, evaluate, evidence, ground, retrieve, understand, vector
from ..sources import files
from ..sources.scratch import scratch_scope

log = logging.getLogger(__name__)

#: Steps by number (from 1) and the tables that each makes.
STEPS = {
    "understand": ("entities", "relations", "mismatches", "arbitration_errors", "questions"),
    "graph": ("facts_table", "fact_vectors", "fact_index"),
    "retrieve": ("candidates", "retrieved", "empty", "semantic"),
    "filter": ("evidence", "counts"),
    "answer": ("facts", "replies", "predictions"),
    "evaluate": ("scores", "wrong"),
}


@dataclass
class Inputs:
    """Tables of a run; those of skipped steps are read from the output folder."""

    facts: DataFrame
    questions: DataFrame
    entities: DataFrame
    relations: DataFrame


def run(
    inputs: Inputs, config: EngineConfig = EngineConfig(), start_step: int = 1, causal: bool = True, out: str | None = None, generator: Callable[[], Generator] | None = None,
    encoder: vector.Encoder | None = None, understand_questions: bool = False, encoder_name: str | None = None, evidence_source: str = "semantic",
) -> dict[str, DataFrame]:
    """All steps as lazy tables by name; with ``out`` each is written there, as a new version of the table, and read
    again, and ``start_step`` takes the newest complete versions of earlier steps from there.  The tables of the run
    before stay readable.

    understand (if asked for; else the questions must have their fields): entities, relations, questions.
    graph: with ``out``, the fact table clustered by year, the facts' vectors and an index of them, all kept for later runs; a
    text that the encoder has met in an earlier run is not encoded again (an encoder of one's own needs a name for that).
    retrieve: candidates (relations for each question), retrieved (graph facts), empty (questions without), semantic.
    filter: evidence, counts; of semantic facts or, with ``evidence_source`` "graph", of retrieved ones.  answer: facts, predictions.  evaluate: scores, wrong."""
    spark = inputs.facts.sparkSession
    tables: dict[str, DataFrame] = {}
    number = {table: k for k, made in enumerate(STEPS.values(), 1) for table in made}

    def step(name: str, build: Callable[[], DataFrame], rated: bool = False) -> DataFrame:
        if out and number[name] < start_step:
            tables[name] = spark.read.parquet(files.current_version(spark, f"{out}/{name}"))
            return tables[name]
        if out:
            with scratch_scope():
                df = build()
                path = files.new_version(spark, f"{out}/{name}")
                if rated:
                    rates = with_rates(df, lambda x: files.write_results(x, path))
                    log.info("%s: %d, %d without an answer, in %.1f s, %.2f a second", name, rates["total"], rates["failed"], rates["seconds"], rates["per_second"])
                else:
                    files.write_results(df, path)
            df = spark.read.schema(df.schema).parquet(path)
        else:
            df = build()
        tables[name] = df
        return df

    q, facts = inputs.questions, inputs.facts
    if understand_questions:
        built = {} if out and start_step > 1 else understand.understand(q, inputs.entities, config, generator, encoder)
        for name in ("entities", "relations", "mismatches", "arbitration_errors"):
            if name in built:
                step(name, lambda name=name: built[name])
        q = step("questions", lambda: built["understood"])

    def sentences() -> DataFrame:
        text = render_sentence(F.col("s"), F.col("r"), F.col("o"), F.col("d"))
        return facts.where("d is not null").select("line_no", text.alias("fact"))

    if out and start_step <= 2:
        files.write_facts(facts, files.new_version(spark, f"{out}/facts_table"))
        store = f"{out}/vector_store" if encoder is None or encoder_name else None
        path = files.new_version(spark, f"{out}/fact_vectors")
        files.write_results(vector.fact_vectors(sentences(), encoder, store, encoder_name or "hashing-256"), path)
        known = spark.read.parquet(path)
        with scratch_scope():
            vector.VectorIndex.build(known, files.new_version(spark, f"{out}/fact_index"), vector.cells_for(known.count()))
    index = None
    if out:
        facts = spark.read.parquet(files.current_version(spark, f"{out}/facts_table")).drop("year")
        known = spark.read.parquet(files.current_version(spark, f"{out}/fact_vectors"))
        index = vector.VectorIndex(spark, files.current_version(spark, f"{out}/fact_index"))
    else:
        known = vector.fact_vectors(sentences(), encoder)

    def candidates() -> DataFrame:
        ranked = vector.rank_relations(q.select("relation"), inputs.relations, config.relation_top_k, encoder)
        return ground.spread(q, ranked)

    cand = step("candidates", candidates)
    found = step("retrieved", lambda: retrieve.retrieve(q, cand, facts, inputs.entities, config.order, config.direction_limit))
    step("empty", lambda: retrieve.empty_questions(q, found))
    semantic = step("semantic", lambda: vector.search_vectors(q, known, config.semantic_top_k, encoder, index=index).select("quid", "rank", "fact_id", "score", "fact"))
    if causal:
        with scratch_scope() if out else nullcontext():
            pool = evidence.facts_of_ids(semantic, facts) if evidence_source == "semantic" else evidence.collect_graph_facts(found)
            lookup = q.select("quid", "cue", "time", "reference_target")
            cues = evidence.infer_cue_and_anchor(q, lookup, pool)
            verdicts = evidence.trace_verifier(q, generator) if generator is not None and config.verify else None
            kept, counts = evidence.filter_evidence(pool, cues, config, verdicts=verdicts)
            kept = step("evidence", lambda: kept)
            counts = step("counts", lambda: counts)
        filtered = kept.join(counts.select("quid", "triggered"), "quid").select("quid", "pos", render_sentence(F.col("s"), F.col("r"), F.col("o"), F.col("d")).alias("fact"), "triggered")
    else:
        filtered = semantic.limit(0).select("quid", F.lit(1).alias("pos"), "fact", F.lit(False).alias("triggered"))
    shown_facts = step("facts", lambda: answer.cascade(found, semantic, filtered, config.override))

    def predictions() -> DataFrame:
        if generator is None:
            usable = found.where("kind = 'retrieved'").select("quid", "s", "o", "d")
            return answer.predictions(q, usable).withColumn("answerer", F.lit("extractive"))
        replies = step("replies", lambda: generate(answer.prompts(q, shown_facts), generator), rated=True)
        shown = q.select("quid", "question", "qtype", "qlabel", "answer_type", F.col("answers").alias("ground_truth"), "time_level")
        return shown.join(answer.parse_answers(replies), "quid").withColumn("answerer", F.lit(config.answerer))

    given = step("predictions", predictions)
    step("scores", lambda: evaluate.report(given, config.hit_k))
    step("wrong", lambda: evaluate.wrong_cases(given, config.hit_k))
    return tables


def export(tables: dict[str, DataFrame], folder: str, indent: int = 4) -> dict[str, int]:
    """The result tables as JSON arrays, one file each, and their numbers of rows."""
    return {name: files.write_json_array(tables[name], f"{folder}/{name}.json", indent) for name in ("retrieved", "empty", "semantic", "evidence", "predictions", "wrong") if name in tables}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Answer and score temporal questions over a fact graph.")
    parser.add_argument("--facts", help="tab-separated quads")
    parser.add_argument("--questions", help="JSON array of questions, or .jsonl")
    parser.add_argument("--entities", help="dictionary: name<tab>id")
    parser.add_argument("--relations", help="dictionary: JSON object or name<tab>id")
    parser.add_argument("--out", required=True, help="folder of result tables")
    parser.add_argument("--start-step", type=int, default=1, choices=range(1, 7))
    parser.add_argument("--no-causal", action="store_true")
    parser.add_argument("--evidence", default="semantic", choices=("semantic", "graph"), help="which facts the filter reduces")
    parser.add_argument("--understand", action="store_true", help="questions are raw text: find entities, relation and time first")
    parser.add_argument("--json", metavar="FOLDER", help="write the result tables as JSON arrays, too")
    parser.add_argument("--order", default="time", choices=("time", "ingest"))
    parser.add_argument("--eval-only", metavar="PREDICTIONS", help="score a table of predictions")
    parser.add_argument("-k", type=int, default=1)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.eval_only:
        evaluate.report(spark.read.parquet(files.current_version(spark, args.eval_only)), args.k).orderBy("dimension", "value").show(100, False)
        return
    inputs = Inputs(files.read_quads(spark, args.facts), files.read_questions(spark, args.questions), files.read_dictionary(spark, args.entities), files.read_dictionary(spark, args.relations))
    config = replace(EngineConfig(), order=args.order, hit_k=args.k)
    tables = run(inputs, config, args.start_step, not args.no_causal, args.out, understand_questions=args.understand, evidence_source=args.evidence)
    if args.json:
        export(tables, args.json)
    tables["scores"].orderBy("dimension", "value").show(100, False)


if __name__ == "__main__":
    main()
