"""Models behind functions: embedders, generators and judges, local or over HTTP, with limits, retries and isolation."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

Encode = Callable[[list[str]], np.ndarray]


def term_place(term: str, dims: int) -> tuple[int, float]:
    """Place and sign of a term in a hashed vector, from the hexadecimal digits of its MD5."""
    h = hashlib.md5(term.encode()).hexdigest()
    return int(h[:7], 16) % dims, 1.0 if h[7] >= "8" else -1.0


@dataclass(frozen=True)
class Embedder:
    """``make`` gives a worker's function from texts to rows of ``dims`` numbers; without it terms are hashed."""

    dims: int = 256
    query_prefix: str = ""
    document_prefix: str = ""
    make: Callable[[], Encode] | None = None
    batch: int = 32

    def documents(self, df: DataFrame, text: str) -> DataFrame:
        """df with ``v``, unit vectors of double precision."""
        return self._embedded(df, F.concat(F.lit(self.document_prefix), F.coalesce(F.col(text), F.lit(""))), "v")

    def queries(self, df: DataFrame, text: str) -> DataFrame:
        return self._embedded(df, F.concat(F.lit(self.query_prefix), F.coalesce(F.col(text), F.lit(""))), "qv")

    def _embedded(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        return df.withColumn(name, self._hashed(tokens(text)) if self.make is None else self._encoded(text))

    def _hashed(self, terms: Column) -> Column:
        dims = self.dims

        @F.arrow_udf("array<double>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                coded = lists.flatten().dictionary_encode()
                places = [term_place(t, dims) for t in coded.dictionary.to_pylist()]
                at, sign = np.array([p for p, _ in places], np.int64), np.array([s for _, s in places])
                code = coded.indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *[n or 0 for n in pc.list_value_length(lists).to_pylist()]])
                out = []
                for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    v = np.bincount(at[code[a:z]], sign[code[a:z]], dims) if z > a else np.zeros(dims)
                    out.append(v / max(float(np.sqrt(v @ v)), 1e-12))
                yield pa.array(out, pa.list_(pa.float64()))

        return embed(terms)

    def _encoded(self, text: Column) -> Column:
        make, dims, size = self.make, self.dims, self.batch

        @F.arrow_udf("array<double>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = make()  # a model a worker
            for texts in batches:
                texts, out = texts.to_pylist(), []
                for i in range(0, len(texts), size):
                    x = np.asarray(encode(texts[i : i + size]), np.float64)
                    if x.shape[1:] != (dims,):
                        raise ValueError(f"the model gives {x.shape[1:]} numbers a text, not {dims}")
                    out += list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
                yield pa.array(out, pa.list_(pa.float64()))

        return embed(text)


EMBEDDERS: dict[str, Embedder] = {"hashed": Embedder(), "hashed_small": Embedder(64), "hashed_prefixed": Embedder(256, "query: ", "passage: ")}


def get_embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]


class RateLimiter:
    """At most ``most`` calls in any ``seconds``; each worker has its own, so a cluster's limit is shared out."""

    def __init__(self, most: int, seconds: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.most, self.seconds, self.clock, self.sleep = most, seconds, clock, sleep
        self.calls: deque[float] = deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.most:
                self.calls.append(now)
                return
            self.sleep(self.seconds - (now - self.calls[0]))


def retried(call: Callable[[], str], tries: int = 3, pause: float = 1.0, sleep=time.sleep) -> str:
    """The first success; pauses double from one failure to the next, and the last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n + 1 == tries:
                raise
            sleep(pause * 2**n)
    raise ValueError("no tries")


def post_json(url: str, body: dict, timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def http_generator(url: str, model: str, context: int = 8192, most_tokens: int = 700) -> Callable[[], Callable[[str], str]]:
    """A worker's client of a generation service that takes {model, prompt, stream, options} and replies {response}."""
    options = {"temperature": 0, "num_ctx": context, "num_predict": most_tokens}
    return lambda: lambda prompt: post_json(url, {"model": model, "prompt": prompt, "stream": False, "options": options})["response"].strip()


def http_encoder(url: str, model: str) -> Callable[[], Encode]:
    """A worker's client of an embedding service that takes {model, input} and replies {embeddings}."""
    return lambda: lambda texts: np.array(post_json(url, {"model": model, "input": texts})["embeddings"], np.float64)


def called(prompt: Column, make: Callable[[], Callable[[str], str]], most: int | None = None, seconds: float = 60.0, tries: int = 1, pause: float = 1.0) -> Column:
    """struct(text, error, ms): a model's reply to each prompt.  A record that fails has its error and no text, and the
    others go on; a null prompt is not sent."""

    @F.arrow_udf("text string, error string, ms double")
    def reply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client, limiter = make(), RateLimiter(most, seconds) if most else None
        for prompts in batches:
            texts, errors, times = [], [], []
            for p in prompts.to_pylist():
                began, text, error = time.time(), None, None
                if p is not None:
                    try:
                        if limiter:
                            limiter.wait()
                        text = retried(lambda p=p: client(p), tries, pause)
                    except Exception as e:  # kept beside the record
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
                times.append((time.time() - began) * 1000)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(times, pa.float64())], ["text", "error", "ms"])

    return reply(prompt)


PROMPT = """Answer the question from the sources alone.
Cite the source of every statement by its number in square brackets, such as [1].
If the sources do not answer the question, say so and do not guess.

Sources:
{sources}

Question: {question}
Answer:"""


def rendered(template: str, **columns: Column) -> Column:
    """A template's text with its {names} replaced by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])
