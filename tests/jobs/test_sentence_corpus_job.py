"""The sentence corpus against a plain reading of the same texts; runs again with the same result."""

import json
import string

import pytest

from jobs import command, sentence_corpus
from jobs.sentence_corpus import build_sentence_corpus, read_corpus

DOCS = [
    (1, "The cat sat.  A cat sat!\nBefore noon it left. one", "en"), (2, None, "en"), (3, "", None), (4, "cat   sat", "fr"), (4, "cat   sat", "fr"),
    (5, "Zwei Wörter? Ja. Vor dem Ende\n\n", "de"), (None, "no id here", None), (6, "word " * 3000, "en"), (7, "!!! --- ...", "en"),
]
TALK = [(1, 0, "the CAT sat"), (1, 1, "Same again, last time."), (2, 0, None)]


def plain(docs, talk, least=2):
    import re

    first, seen = {}, {}
    rows = [("documents", i, 0, lang, t) for i, t, lang in docs] + [("conversations", i, p, None, t) for i, p, t in talk]
    for origin, i, part, lang, text in rows:
        for pos, s in enumerate(re.sub(r"([.!?])[ \t\r\n]+", "\\1\n", text).split("\n") if text is not None else []):
            s = " ".join(s.split())
            key = " ".join(w for w in s.lower().translate(str.maketrans("", "", string.punctuation)).split() if w not in ("a", "an", "the"))
            if len(key.split()) < least:
                continue
            seen[key] = seen.get(key, 0) + 1
            place = (origin, (i is not None, i or 0), part, pos, s, lang or "")
            first[key] = min(first.get(key, place), place)
    cue = lambda s: next((c for c in ("before", "after", "first", "last", "same") if re.search(rf"\b{c}\b", s.lower())), None)
    return sorted(((s, i[1] if i[0] else None, part, pos, seen[k], len(k.split()), cue(s), o, lang or None) for k, (o, i, part, pos, s, lang) in first.items()), key=str)


@pytest.fixture
def inputs(spark, tmp_path):
    spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, sentence string, pos int").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(TALK, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/c")
    return f"{tmp_path}/d", f"{tmp_path}/c", f"{tmp_path}/out"


def test_equals_a_plain_reading_and_runs_again(spark, inputs):
    done = [build_sentence_corpus(spark, *inputs) for _ in range(2)]
    assert done[0] == done[1] and (done[0]["documents"], done[0]["turns"]) == (len(DOCS), len(TALK))
    got = sorted(map(tuple, read_corpus(spark, inputs[2]).collect()), key=str)
    assert got == plain(DOCS, TALK) and len(got) == done[0]["written"]
    assert [r[4] for r in got if r[0] == "the CAT sat"] == [5]
    # Partitions are read alone.
    assert {r.lang for r in read_corpus(spark, inputs[2]).where("origin = 'documents' and lang = 'de'").collect()} == {"de"}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/c")
    assert build_sentence_corpus(spark, f"{tmp_path}/d", f"{tmp_path}/c", f"{tmp_path}/out")["written"] == 0


def test_command_line(spark, inputs, tmp_path, monkeypatch):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"least_words": 3}))

    class Kept:
        """A session that the command line may not stop in a test."""

        def __init__(self):
            self.stopped = False

        def appName(self, _):
            return self

        def getOrCreate(self):
            return self

        def stop(self):
            self.stopped = True

        def __getattr__(self, name):
            return getattr(spark, name)

    kept = Kept()
    monkeypatch.setattr(command, "SparkSession", type("S", (), {"builder": kept}))
    args = ["--documents", inputs[0], "--conversations", inputs[1], "--out", inputs[2], "--config", str(config)]
    done = command.run(build_sentence_corpus, {"documents": "", "conversations": "", "out": ""}, args)
    assert kept.stopped and done["written"] == len(plain(DOCS, TALK, 3))


def test_texts_are_normalised_once_each(spark):
    rows = spark.createDataFrame([("documents", 1, 0, "en", "The cat sat. A cat  sat!\nNo.")], "origin string, id long, part long, lang string, text string")
    got = sentence_corpus.corpus_of(rows, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(a|an|the)") == 1
    assert [(r.sentence, r.n_seen, r.n_words) for r in got.collect()] == [("The cat sat.", 2, 2)]
