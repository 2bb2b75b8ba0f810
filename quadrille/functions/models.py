"""Model boundaries: generators behind an Arrow UDF, with retries, threads and offline defaults."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Generator = Callable[[str], str]


class Batched:
    """A model that answers lists of at most ``size`` prompts at once."""

    def __init__(self, call: Callable[[list[str]], list[str]], size: int):
        self.call, self.size = call, size

    def replies(self, prompts: list[str], retries: int, base: float) -> list[str]:
        """Replies in order; an empty prompt has an empty one.  A list that fails is tried again, then prompt by
        prompt, so that one prompt's failure is its own."""
        out, asked = [""] * len(prompts), [i for i, p in enumerate(prompts) if p]
        for k in range(0, len(asked), self.size):
            some = asked[k : k + self.size]
            try:
                got = self.call([prompts[i] for i in some])
            except Exception:
                single = with_retry(lambda p: self.call([p])[0], retries, base)
                got = [single(prompts[i]) for i in some]
            for i, reply in zip(some, got, strict=True):
                out[i] = reply or ""
        return out


def with_retry(call: Generator, retries: int = 2, base: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Generator:
    """``call`` tried again up to ``retries`` times, waiting base ** attempt seconds; then empty text."""

    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt) or ""
            except Exception:  # a model's failure is an empty reply, whatever it was
                if attempt < retries:
                    sleep(base**attempt)
        return ""

    return run


class Pace:
    """Lets calls begin at most ``per_second`` times a second, over all threads of a task."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.lock, self.clock, self.sleep = 1 / per_second, clock(), threading.Lock(), clock, sleep

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            begin = max(now, self.next)
            self.next = begin + self.gap
        if begin > now:
            self.sleep(begin - now)


def packs(rows: Iterator[tuple[int, str, int]], budget: int) -> Iterator[list[tuple[int, str, int]]]:
    """Rows (quid, prompt, tokens) in lists whose padded size, rows times the longest, is at most ``budget``; a longer prompt alone."""
    held: list[tuple[int, str, int]] = []
    longest = 0
    for row in rows:
        if held and (len(held) + 1) * max(longest, row[2]) > budget:
            yield held
            held, longest = [], 0
        held.append(row)
        longest = max(longest, row[2])
    if held:
        yield held


def token_estimate(prompt: Column) -> Column:
    """About a token for four characters."""
    return F.expr("1").cast("long") + F.floor(F.coalesce(F.length(prompt), F.lit(0)) / 4)


def generate(
    prompts: DataFrame, make: Callable[[], Generator | Batched], concurrency: int = 32, retries: int = 2, base: float = 1.5, budget: int | None = None, tokens: Callable[[Column], Column] = token_estimate,
    per_second: float | None = None, workers: int = 8,
) -> DataFrame:
    """(quid, raw) of (quid, prompt): one client for each partition, ``concurrency`` calls (or lists of a
    batched model's size) at a time, replies in order.  A null prompt has an empty reply.

    ``budget``: prompts are sorted by ``tokens`` over all partitions and packed, so that a list of a batched model holds so many tokens
    and hardly any padding.  ``per_second``: calls of the whole job; prompts then go to ``workers`` partitions, each with its share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        if isinstance(model, Batched):
            pace = Pace(per_second / workers) if per_second else None
            if budget:
                rows = (r for b in batches for r in zip(b["quid"].tolist(), b["prompt"].tolist(), b["n"].tolist(), strict=True))
                lists = ([(quid, prompt or "") for quid, prompt, _ in pack] for pack in packs(rows, budget))
                model = Batched(model.call, budget)
            else:
                lists = (list(zip(b["quid"].tolist(), (p or "" for p in b["prompt"]), strict=True)) for b in batches)
            for some in lists:
                if pace:
                    pace.wait()
                yield pd.DataFrame({"quid": [quid for quid, _ in some], "raw": model.replies([p for _, p in some], retries, base)})
            return
        call = with_retry(model, retries, base)
        if per_second:
            pace, unpaced = Pace(per_second / workers), model
            call = with_retry(lambda p: (pace.wait(), unpaced(p))[1], retries, base)
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                raw = list(pool.map(lambda p: call(p) if p else "", b["prompt"]))
                yield pd.DataFrame({"quid": b["quid"], "raw": raw})

    rows = prompts.select(F.col("quid").cast("long").alias("quid"), "prompt")
    if budget:
        rows = rows.withColumn("n", tokens(F.col("prompt")))
        rows = (rows.repartitionByRange(workers, "n") if per_second else rows.repartitionByRange("n")).sortWithinPartitions("n", "quid")
    elif per_second:
        rows = rows.repartition(workers)
    return rows.mapInPandas(run, "quid long, raw string")


def http_generator(url: str, model: str, key: str = "", temperature: float = 0.0, max_tokens: int = 256, timeout: float = 60.0) -> Callable[[], Generator]:
    """A client of a chat-completions service."""

    def make() -> Generator:
        import urllib.request

        def call(prompt: str) -> str:
            body = json.dumps({"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return call

    return make


def local_generator(load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 8) -> Callable[[], Batched]:
    """A model that is loaded once for each partition by ``load`` and called with lists of at most ``batch`` prompts."""
    return lambda: Batched(load(), batch)


def with_rates(replies: DataFrame, write: Callable[[DataFrame], object], clock: Callable[[], float] = time.monotonic) -> dict[str, float]:
    """Writes (quid, raw) by ``write`` and counts on the way: total, answered, failed (empty), seconds, per_second."""
    seen = Observation()
    start = clock()
    write(replies.observe(seen, F.count(F.lit(1)).alias("total"), F.count(F.nullif(F.col("raw"), F.lit(""))).alias("answered")))
    seconds = max(clock() - start, 1e-9)
    try:
        got = seen.get
    except Py4JJavaError:  # Spark saw that there was nothing to run
        got = {"total": 0, "answered": 0}
    return {"total": got["total"], "answered": got["answered"], "failed": got["total"] - got["answered"], "seconds": seconds, "per_second": got["total"] / seconds}


def listing_generator() -> Callable[[], Generator]:
    """The offline default: answers with the last words of the prompt's facts, so that replies are deterministic."""

    def make() -> Generator:
        def call(prompt: str) -> str:
            facts = re.search(r"Facts: (\[.*\])\s*$", prompt, re.S)
            return json.dumps({"answers": sorted({x.rsplit(" in ", 1)[0].split(" ")[-1] for x in json.loads(facts[1])})}) if facts else ""

        return call

    return make
