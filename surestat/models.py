"""The boundary to models. A provider is created once in each worker process by a picklable factory; the engine ships a
deterministic stub that stands in for models in tests. Its outputs mean nothing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .config import ENTAILMENT_SENTENCE
from .functions import text as T

FAMILIES = ("llama", "qwen", "mistral", "gemma")


class Provider(Protocol):
    """What the engine asks of models. Each call takes a batch of rows and returns a result for each, in order."""

    def extract(self, prompts: list[str], max_tokens: int = 512) -> list[str]: ...

    def sample(self, prompts: list[str], n: int, temperature: float, top_p: float, max_tokens: int, seeds: list[int]) -> list[list[str]]: ...

    def generate(self, prompts: list[str], max_tokens: int, repetition_penalty: float, no_repeat: int) -> list[tuple[list[str], list[float], list[float]]]: ...

    def force(self, prompts: list[str], prefix: str, names: list[list[str]]) -> list[list[tuple[list[float], list[float]]]]: ...

    def alternatives(self, prompts: list[str], prefixes: list[str], top_k: int, max_tokens: int) -> list[list[tuple[str, float]]]: ...

    def entail(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def embed(self, names: list[str]) -> np.ndarray: ...

    def align(self, prompts: list[str]) -> list[str]: ...

    def tokenize(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, which joined give it back."""


class Stub:
    """Deterministic stand-in, by hashes of its inputs."""

    names = ["Sepsis", "Pneumonia", "Heart failure", "Gout", "Anemia", "Stroke"]

    @staticmethod
    def _number(*x: object) -> float:
        return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=6).digest(), "big") / 2**48

    def extract(self, prompts, max_tokens=512):
        return [f'```json\n["{self.names[int(self._number(p) * 6)]} (x)"]\n```' for p in prompts]

    def sample(self, prompts, n, temperature, top_p, max_tokens, seeds):
        pick = lambda *x: self.names[int(self._number(*x) * 6)]
        return [[f"- {pick(p, s, i)}\n- {pick(s, i, p)}" for i in range(n)] for p, s in zip(prompts, seeds, strict=True)]

    def generate(self, prompts, max_tokens, repetition_penalty, no_repeat):
        return [self._generated(p) for p in prompts]

    def _generated(self, prompt):
        tokens = ["- ", self.names[int(self._number(prompt) * 6)], "\n", "- ", self.names[int(self._number(prompt, 1) * 6)], "\n"]
        p = [0.05 + 0.9 * self._number(prompt, i) for i in range(len(tokens))]
        return tokens, p, [1 - x for x in p]

    def force(self, prompts, prefix, names):
        return [self._forced(p, prefix, n) for p, n in zip(prompts, names, strict=True)]

    def _forced(self, prompt, prefix, names):
        return [([0.05 + 0.9 * self._number(prompt, prefix, n, i) for i in range(len(n.split()))], [self._number(n, i) for i in range(len(n.split()))]) for n in names]

    def alternatives(self, prompts, prefixes, top_k, max_tokens):
        return [[(self.names[(i + int(self._number(p, x) * 6)) % 6], 0.5 ** (i + 1)) for i in range(top_k)] for p, x in zip(prompts, prefixes, strict=True)]

    def entail(self, pairs):
        return [0.9 if a.split()[:6] == b.split()[:6] else 0.1 for a, b in pairs]

    def embed(self, names):
        return np.array([[self._number(n, i) - 0.5 for i in range(16)] for n in names])

    def align(self, prompts):
        return ["" for _ in prompts]

    def tokenize(self, texts):
        return [re.findall(r"\s*\S+|\s+$", t) for t in texts]


_made: dict[str, Provider] = {}


def provider(factory: Callable[[], Provider]) -> Provider:
    """This process's provider of a factory: models load once in each worker."""
    name = f"{factory.__module__}.{getattr(factory, '__qualname__', factory)}"
    if name not in _made:
        _made[name] = factory()
    return _made[name]


def _batched(rows: DataFrame, schema: str, call: Callable[[Provider, pd.DataFrame], list[list[tuple]]], factory: Callable[[], Provider]) -> DataFrame:
    """call gets a batch of rows and returns the resulting rows of each."""
    names = [x.strip().split(" ")[0] for x in schema.split(",") if " " in x.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for found in call(provider(factory), batch) for x in found], columns=names)

    return rows.mapInPandas(run, schema)


def tokenized(rows: DataFrame, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, text) to (index, tokens), which joined give the text back."""
    return _batched(rows.select("index", "text"), "index long, tokens array<string>", lambda m, b: [[x] for x in zip(b["index"], m.tokenize(b["text"].tolist()), strict=True)], factory)


def shortened(rows: DataFrame, most: int, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, text) with the last `most` tokens of each text; null texts stay null."""
    cut = tokenized(rows.where("text IS NOT NULL"), factory).select("index", F.array_join(T.last_tokens(F.col("tokens"), most), "").alias("text"))
    return cut.unionByName(rows.where("text IS NULL").select("index", "text"))


def extracted(prompts: DataFrame, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, prompt) to (index, reply)."""
    return _batched(prompts.select("index", "prompt"), "index long, reply string", lambda m, b: [[x] for x in zip(b["index"], m.extract(b["prompt"].tolist()), strict=True)], factory)


def sampled(prompts: DataFrame, n: int = 100, temperature: float = 0.6, top_p: float = 0.9, max_tokens: int = 512, seed: int = 0, batch: int = 10, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, prompt) to (index, sample_id, text), `batch` samples of a prompt in one call; seeds depend on the note and on the first sample of
    the call, so a retried task gives the same."""

    def call(m: Provider, b: pd.DataFrame) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in range(len(b))]
        for first in range(0, n, batch):
            seeds = [(seed + int(i)) * 1_000_003 + first for i in b["index"]]
            texts = m.sample(b["prompt"].tolist(), min(batch, n - first), temperature, top_p, max_tokens, seeds)
            for held, i, some in zip(out, b["index"], texts, strict=True):
                held += [(i, first + j, t) for j, t in enumerate(some)]
        return out

    return _batched(prompts.select("index", "prompt"), "index long, sample_id int, text string", call, factory)


def generated(prompts: DataFrame, max_tokens: int = 512, repetition_penalty: float = 1.2, no_repeat: int = 3, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, prompt) to (index, tokens, probs, entropies)."""
    call = lambda m, b: [[(i, *x)] for i, x in zip(b["index"], m.generate(b["prompt"].tolist(), max_tokens, repetition_penalty, no_repeat), strict=True)]
    return _batched(prompts.select("index", "prompt"), "index long, tokens array<string>, probs array<double>, entropies array<double>", call, factory)


def forced(rows: DataFrame, prefix: str = "\n-", factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, prompt, diseases) to (index, disease, pos, prob, entropy), in long form. Expanded names take the prefix "\\n- "."""

    def call(m: Provider, b: pd.DataFrame) -> list[list[tuple]]:
        names = [list(x) for x in b["diseases"]]
        traces = m.force(b["prompt"].tolist(), prefix, names)
        return [[(i, n, at, p, e) for n, (ps, es) in zip(own, trace, strict=True) for at, (p, e) in enumerate(zip(ps, es, strict=True))] for i, own, trace in zip(b["index"], names, traces, strict=True)]

    return _batched(rows.select("index", "prompt", "diseases"), "index long, disease string, pos int, prob double, entropy double", call, factory)


def alternatives(rows: DataFrame, top_k: int = 5, max_tokens: int = 20, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, prompt, prefix, disease) to (index, disease, rank, alternative, prob): first lines of the greedy completions."""

    def call(m: Provider, b: pd.DataFrame) -> list[list[tuple]]:
        found = m.alternatives(b["prompt"].tolist(), b["prefix"].tolist(), top_k, max_tokens)
        return [[(i, d, rank, t.split("\n")[0].strip(), p) for rank, (t, p) in enumerate(some)] for i, d, some in zip(b["index"], b["disease"], found, strict=True)]

    return _batched(rows.select("index", "prompt", "prefix", "disease"), "index long, disease string, rank int, alternative string, prob double", call, factory)


def entailment(pairs: DataFrame, a: str = "a", b: str = "b", factory: Callable[[], Provider] = Stub) -> DataFrame:
    """Adds forward and backward: the probabilities that the sentence about one name entails that about the other. Give it
    distinct pairs; names that are equal but for case and outer blanks aren't asked about, and have 1."""
    schema = StructType([*pairs.schema.fields, StructField("forward", DoubleType()), StructField("backward", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ahead = [(ENTAILMENT_SENTENCE.format(x), ENTAILMENT_SENTENCE.format(y)) for x, y in zip(batch[a], batch[b], strict=True)]
            ask = [i for i, (x, y) in enumerate(zip(batch[a], batch[b], strict=True)) if x.strip().lower() != y.strip().lower()]
            forward, backward = np.ones(len(batch)), np.ones(len(batch))
            if ask:
                forward[ask] = provider(factory).entail([ahead[i] for i in ask])
                backward[ask] = provider(factory).entail([ahead[i][::-1] for i in ask])
            yield batch.assign(forward=forward, backward=backward)

    return pairs.mapInPandas(run, schema)


def answers(rows: DataFrame, factory: Callable[[], Provider] = Stub) -> DataFrame:
    """(index, original, prompt) to (index, original, answer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["index", "original"]].assign(answer=provider(factory).align(batch["prompt"].tolist()))

    return rows.mapInPandas(run, "index long, original string, answer string")
