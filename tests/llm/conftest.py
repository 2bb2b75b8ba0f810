import random

import pytest

from llm_helpers import sentence


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and extra columns whose
    names clash with results and inner names."""
    rng = random.Random(3)
    base = sentence(rng, 60)
    near = base.split()
    near[7] = "other"
    texts = [base, base, " ".join(near), base.upper(), "", None, "  \n\t ", "one two", "one two", "ONE  two", sentence(rng, 30_000), "!!! 123 --", "é ñ ü", sentence(rng, 5)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None), (99, sentence(rng, 40), None, None, None), (98, None, None, None, None)]
    clash = "component_id long, shard int, lang_pred string, lang_score double, path long, n long, doc long, size long, taken long, kept boolean, score double, sig array<int>"
    full = [(*r, 1, 2, "x", 0.5, 3, 4, 5, 6, 7, True, 0.1, [1]) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
