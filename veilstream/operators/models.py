"""Model layers: injected functions, their output as spans, and their cost.

No model is part of this repository. A layer is a function over Arrow batches that a caller supplies; without one the
layer passes its input on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions import fixed
from veilstream.operators.recognize import SPANS, from_model
from veilstream.operators.spans import realign

#: Characters of a text that a language model is given.
MOST_CHARS = 8000


class SpanModel(Protocol):
    """Finds spans: from rows (doc_id, text) to rows (doc_id, text, label, start, end, score)."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class TextModel(Protocol):
    """Answers prompts: from rows (doc_id, prompt) to rows (doc_id, answer)."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Adapters:
    """Text models by provider."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], TextModel]] = {}

    def add(self, provider: str, make: Callable[[], TextModel]) -> None:
        self._known[provider] = make

    def get(self, provider: str) -> TextModel:
        if provider not in self._known:
            raise ValueError(f"unknown provider: {provider}; known: {', '.join(sorted(self._known)) or 'none'}")
        return self._known[provider]()


def model_spans(docs: DataFrame, model: SpanModel | None, threshold: float = 0.5, labels: DataFrame | None = None, usual: tuple[str, ...] = tuple(fixed.ZERO_SHOT_LABELS)) -> DataFrame:
    """Spans of a model's layer over docs (doc_id, text); none without a model.

    With labels (session_id, labels array) and docs that have a session_id, the model is given a column `labels`: those
    of the text's session, else the usual ones. A session with an empty list is not asked about.
    """
    if model is None:
        return docs.sparkSession.createDataFrame([], SPANS)
    given = docs.select("doc_id", "text")
    if labels is not None:
        own = docs.join(labels.select("session_id", "labels"), "session_id", "left")
        given = own.select("doc_id", "text", F.coalesce("labels", F.array(*map(F.lit, usual))).alias("labels")).where(F.size("labels") > 0)
    return from_model(given.mapInPandas(model, "doc_id long, text string, label string, start int, end int, score double"), threshold)


def answers(prompts: DataFrame, model: TextModel, tries: int = 6, wait: float = 5.0, most: int | None = MOST_CHARS) -> DataFrame:
    """(doc_id, answer) for prompts (doc_id, prompt); prompts that a failed call has not answered are asked again, then answered by null.

    A prompt is cut to `most` characters (None: not cut); to ask about all of a long text, give a prompt for each chunk
    (chunks.chunk).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            left = batch
            for more in reversed(range(tries)):
                try:
                    for out in model(iter([left])):
                        yield out
                        left = left[~left["doc_id"].isin(out["doc_id"])]
                    break  # what the model has passed over in silence stays unanswered
                except OSError:  # the model's server is not there (yet)
                    if more and len(left):
                        time.sleep(wait)
                if not len(left):
                    break
            else:
                yield left[["doc_id"]].assign(answer=None)

    return prompts.select("doc_id", F.col("prompt") if most is None else F.substring("prompt", 1, most).alias("prompt")).mapInPandas(run, "doc_id long, answer string")


def gathered(parts: DataFrame) -> DataFrame:
    """(request_id, n, whole) of stored parts (request_id, seq, kind, content) of answers, as the stream operator gives them: texts up to the first `done`; without one, whole is null."""
    ends = F.min(F.when(F.col("kind").isin("done", "error"), F.struct("seq", "kind")))
    rows = parts.groupBy("request_id").agg(ends.alias("end"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", F.coalesce("content", F.lit("")).alias("content"))))).alias("t"))
    texts = F.filter("t", lambda x: F.col("end").isNull() | (x["seq"] < F.col("end.seq")))
    return rows.select("request_id", F.size(texts).cast("long").alias("n"), F.when(F.col("end.kind") == "done", F.array_join(F.transform(texts, lambda x: x["content"]), "")).alias("whole"))


def llm_type(raw: Column) -> Column:
    """A language model's name for a type to ours; null for lists of alternatives and unknown names."""
    value = F.upper(F.btrim(raw))
    table = F.create_map(*[F.lit(x) for kv in fixed.LLM_ALIASES.items() for x in kv])
    value = F.coalesce(F.try_element_at(table, value), value)
    return F.when(~value.rlike(r"[|/]") & value.isin(*[t for t, *_ in fixed.ENTITY_TYPES]), value)


ANSWER = "verified array<struct<text:string,entity_type:string,start:int,end:int,score:double>>, added array<struct<text:string,entity_type:string,start:int,end:int,score:double>>"


def answer_spans(answered: DataFrame) -> DataFrame:
    """Spans from JSON answers: `verified`, then `added`; malformed answers and rows are skipped, scores are at most 1."""
    got = answered.withColumn("j", F.from_json("answer", ANSWER, {"mode": "PERMISSIVE"}))
    both = F.concat(F.coalesce("j.verified", F.array().cast("array<struct<text:string,entity_type:string,start:int,end:int,score:double>>")), F.coalesce("j.added", F.array().cast("array<struct<text:string,entity_type:string,start:int,end:int,score:double>>")))
    rows = got.select("doc_id", F.explode(both).alias("s")).select("doc_id", "s.text", llm_type(F.col("s.entity_type")).alias("entity_type"), "s.start", "s.end", F.least(F.coalesce("s.score", F.lit(0.8)), F.lit(1.0)).alias("score"))
    ok = "text <> '' and entity_type is not null and start >= 0 and end >= start"
    return rows.where(ok).withColumns({"source_layer": F.lit("llm"), "recognizer": F.lit("language model")})


def verify(spans: DataFrame, docs: DataFrame, answered: DataFrame) -> DataFrame:
    """Each document's spans as verified by its answer, put where their text is; where the answer has none, as they were."""
    checked = realign(answer_spans(answered), docs)
    rows = checked.withColumn("_c", F.lit(True)).unionByName(spans.select(*checked.columns).withColumn("_c", F.lit(False)))  # answers are read once
    return rows.withColumn("_g", F.max("_c").over(Window.partitionBy("doc_id"))).where("_c = _g").drop("_c", "_g")


def cost(requests: DataFrame, model: str = fixed.USUAL_MODEL, thinking: str = "high") -> DataFrame:
    """requests (…, prompt, text) with estimated tokens and costs: a token is three characters, output is 0.3 of input."""
    prices = {m: (i, o) for m, i, o in fixed.MODEL_PRICES}
    price_in, price_out = prices.get(model, prices[fixed.USUAL_MODEL])
    share = dict(fixed.THINKING).get(thinking, fixed.USUAL_THINKING)
    tokens = F.greatest(F.floor((F.char_length("prompt") + F.char_length("text") + 2) / 3), F.lit(1)).cast("long")
    rows = requests.withColumn("input_tokens", tokens)
    rows = rows.withColumns({"output_tokens": F.floor(F.col("input_tokens") * 0.3).cast("long"), "thinking_tokens": F.floor(F.col("input_tokens") * share).cast("long")})
    a, b, c = (F.col(n) / 1_000_000 * p for n, p in (("input_tokens", price_in), ("output_tokens", price_out), ("thinking_tokens", price_out)))
    return rows.withColumns({"input_cost": F.bround(a, 6), "output_cost": F.bround(b, 6), "thinking_cost": F.bround(c, 6), "total_cost": F.bround(a + b + c, 6)})
