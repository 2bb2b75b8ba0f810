"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()
_A = T.ArrayType(T.StringType())

FACTS = _struct(line_no=_L, s=_S, r=_S, o=_S, ts_raw=_S, ts=T.TimestampNTZType(), d=_D)
QUESTIONS = _struct(
    quid=_L, question=_S, answers=_A, answer_type=_S, time_level=_S, qtype=_S, qlabel=_S, time=_A, entities=_A,
    arbitration=_S, subject=_S, relation=_S, object=_S, cue=_S, reference_target=_S,
)
RETRIEVED = _struct(quid=_L, cand_rank=_I, rel=_S, kind=_S, pos=_I, s=_S, r=_S, o=_S, d=_D)
SEMANTIC = _struct(quid=_L, rank=_I, fact_id=_L, score=T.DoubleType(), fact=_S)
EVIDENCE = _struct(quid=_L, question=_S, original_fact_num=_I, final_fact_num=_I, final_facts=_A, qtype=_S, qlabel=_S, answer_type=_S, answer=_A)
PREDICTIONS = _struct(quid=_L, question=_S, model_answer=_A, qtype=_S, qlabel=_S, answer_type=_S, ground_truth=_A, time_level=_S)
