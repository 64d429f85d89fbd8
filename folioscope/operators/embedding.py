"""Embedding providers: a registry of functions from texts to dense vectors, called in bounded batches with retries."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: A provider: one vector for each text, in order. It must be importable by the workers.
Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Provider:
    """batch: texts of one call; tries and pause: how often a failing call is made, and the seconds before the second try, doubled for each further one."""

    model_id: str
    embed: Embed
    batch: int = 64
    tries: int = 3
    pause: float = 0.5


_PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    _PROVIDERS[provider.model_id] = provider


def provider(model_id: str) -> Provider:
    """The provider of a model; an unknown one is an error that names those there are."""
    if model_id not in _PROVIDERS:
        raise KeyError(f"no embedding provider {model_id}; there are: {', '.join(sorted(_PROVIDERS)) or 'none'}")
    return _PROVIDERS[model_id]


def in_batches(texts: list[str], p: Provider) -> Iterator[list[float]]:
    """All vectors; a call that gives another number of vectors than texts counts as failed."""
    for at in range(0, len(texts), p.batch):
        part = texts[at : at + p.batch]
        for attempt in range(p.tries):
            try:
                found = p.embed(part)
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                break
            except Exception:
                if attempt + 1 == p.tries:
                    raise
                time.sleep(p.pause * 2**attempt)
        yield from found


def embed(df: DataFrame, id_col: str, text_col: str, p: Provider) -> DataFrame:
    """(id, embedding array<double>) of every text, null as empty; one pass, no shuffle, and no more than a provider's batch in one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(in_batches(batch["text"].tolist(), p))})

    rows = df.select(F.col(id_col).cast("long").alias("id"), X.text_of(F.col(text_col)).alias("text"))
    return rows.mapInPandas(run, "id long, embedding array<double>")


@dataclass(frozen=True)
class HttpEmbed:
    """An external provider: POST of {model, input, dimensions} to url, and a vector for each item of data, in the order of their index. The key is read from the
    environment of the worker, under the name key_env; a missing one, an HTTP error or another answer fails the call.
    """

    url: str
    model_id: str
    key_env: str = ""
    dimensions: int | None = None
    timeout: float = 120.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"}
        if self.key_env:
            headers["Authorization"] = f"Bearer {os.environ[self.key_env].strip()}"
        body = {"model": self.model_id, "input": texts} | ({"dimensions": self.dimensions} if self.dimensions else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            rows = json.load(answer).get("data") or []
        return [[float(x) for x in r["embedding"]] for r in sorted(rows, key=lambda r: int(r.get("index", 0)))]


def letter_profile(texts: list[str]) -> list[list[float]]:
    """A small provider without a model: shares of vowels, digits and blanks."""
    return [[sum(c in kind for c in t) / max(1, len(t)) for kind in ("aeiou", "0123456789", " \t\n")] for t in texts]


register(Provider("letters_v1", letter_profile))
