"""Models behind one protocol, with deterministic stand-ins that need no network.

A model is a function from a pandas Series of prompts to one of answers; ``column`` makes it an Arrow UDF. A cluster passes
its own functions, which load their weights once per worker.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ChatModel = Callable[[pd.Series], pd.Series]
PairModel = Callable[[pd.Series, pd.Series], pd.Series]
ScoredModel = Callable[[pd.Series], pd.DataFrame]  # columns text and logprobs (a list per answer)


@dataclass(frozen=True)
class Params:
    """Settings shared by all tasks and those of each."""

    shared: dict = field(default_factory=dict)
    by_task: dict = field(default_factory=dict)

    def of(self, task: str) -> dict:
        return self.shared | self.by_task.get(task, {})


def column(model: ChatModel, prompt: Column) -> Column:
    """The model's answer to each prompt, batch by batch."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield model(prompts)

    return answer(prompt)


def scored_column(model: ScoredModel, prompt: Column) -> Column:
    """struct<text string, logprobs array<double>>: the model's answer and the log-probability of each of its tokens."""

    @F.pandas_udf("text string, logprobs array<double>")
    def answer(prompts: pd.Series) -> pd.DataFrame:
        return model(prompts)[["text", "logprobs"]]

    return answer(prompt)


def pair_column(model: PairModel, left: Column, right: Column) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return model(a, b)

    return score(left, right)


def echo_model(prompts: pd.Series) -> pd.Series:
    """Answers with the last line of the prompt that is not blank."""
    return prompts.fillna("").map(lambda p: next((line.strip() for line in reversed(p.split("\n")) if line.strip()), ""))


def scored_echo_model(prompts: pd.Series) -> pd.DataFrame:
    """echo_model with a made-up log-probability for each word: minus its length in hundredths, less if the prompt's other lines have it too."""
    texts = echo_model(prompts).str.removeprefix("Question: ")
    seen = [set(p.rpartition("\n")[0].split()) for p in prompts.fillna("")]
    return pd.DataFrame({"text": texts, "logprobs": [[-len(w) / (200.0 if w in s else 100.0) for w in t.split()] for t, s in zip(texts, seen)]})


def question_model(prompts: pd.Series) -> pd.Series:
    """A JSON list with one question and answer about the longest sentence of the prompt's text."""

    def ask(p: str) -> str:
        best = max(re.split(r"(?<=[.!?])\s+", p.rpartition("Text: ")[2].strip()), key=len, default="")
        return json.dumps([{"question": f"What is said about {' '.join(best.split()[:3])}?", "answer": best}], ensure_ascii=False)

    return prompts.fillna("").map(ask)


def choice_model(prompts: pd.Series) -> pd.Series:
    """A JSON list with a question whose options are the first five words of the prompt's text; the length of the text says which is right."""

    def ask(p: str) -> str:
        text = p.partition("\n")[2]
        options = [f"{i}) {w}" for i, w in enumerate(text.split()[:5], 1)]
        return json.dumps([{"question": "Which of these words is it?", "options": options, "answer": str(len(text) % 6)}], ensure_ascii=False)

    return prompts.fillna("").map(ask)


def quoting_model(prompts: pd.Series) -> pd.Series:
    """A JSON list with a question whose answer quotes the beginning of each note, and a last sentence with a quote that stands in none."""

    def ask(p: str) -> str:
        notes = [m.groups() for m in re.finditer(r"(?m)^\d+\) ([^:\n]*): (.*)$", p)]
        said = [{"sentence": f"Note {i}.", "reference": [{"source": source, "text": text[:20]}]} for i, (source, text) in enumerate(notes, 1)]
        return json.dumps([{"question": "What do the notes say?", "answer": [*said, {"sentence": "Made up.", "reference": [{"source": "none", "text": "nowhere"}]}]}], ensure_ascii=False)

    return prompts.fillna("").map(ask)


def overlap_scorer(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of word sets: a stand-in for relevance, faithfulness and reranking models."""

    def score(x: str | None, y: str | None) -> float:
        p, q = set((x or "").lower().split()), set((y or "").lower().split())
        common = len(p & q)
        return 2 * common / (len(p) + len(q)) if common else 0.0

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype=float)


def entailment_logits(premise: Column, hypothesis: Column) -> Column:
    """array(entailment, neutral, contradiction): a deterministic stand-in for an NLI classifier, from word overlap."""

    @F.pandas_udf("array<double>")
    def logits(a: pd.Series, b: pd.Series) -> pd.Series:
        share = overlap_scorer(a, b)
        return pd.Series([[4 * s, 1.0, 1.0 - 2 * s] for s in share])

    return logits(premise, hypothesis)


def hashed_embedding(texts: Column, size: int = 64) -> Column:
    """Unit vectors of hashed words: a stand-in for a text encoder. Empty texts give zeros."""

    @F.pandas_udf("array<float>")
    def embed(batch: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(size)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return batch.map(one)

    return embed(texts)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""

    @F.pandas_udf("double")
    def tail(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)) if x == x else float("nan"))

    return tail(z)
