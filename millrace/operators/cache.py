"""Content-addressed caches, the models behind them, and time-boxed lookups."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import reachable


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key that the cache does not have."""
    return wanted.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")


def get_or_compute(wanted: DataFrame, cache: DataFrame, keys: list[str], value: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(wanted with the value, the cache with the new rows). compute gets the distinct misses and adds the value.

    A key that the cache has twice counts once; running twice adds nothing.
    """
    new = compute(misses(wanted, cache, keys)).select(*keys, value)
    grown = cache.select(*keys, value).dropDuplicates(keys).unionByName(new)
    return wanted.join(grown, keys, "left"), grown


def hashing_vector(text: Column, width: int = 32) -> Column:
    """A deterministic stand-in for an embedder: the first hexadecimal digits of the text's md5, from -0.5 on in steps of a sixteenth."""
    digest = F.md5(text)
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: (F.conv(F.substr(digest, k, F.lit(1)), 16, 10).cast("double") / 16 - 0.5).cast("float"))


TRIES = 3


def attempted(call: Callable[[list[str]], list], texts: list[str], tries: int = TRIES, wait: float = 0.0) -> tuple[list, str | None]:
    """(call's answers for a batch of texts, None); after `tries` failures (no answers, the cause of the last one)."""
    cause = None
    for k in range(tries):
        try:
            answers = list(call(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
            return answers, None
        except Exception as e:  # whatever an injected service raises is told to the caller
            cause = f"{type(e).__name__}: {e}"
            if wait and k + 1 < tries:
                time.sleep(wait * 2**k)
    return [None] * len(texts), cause


def tried(call: Callable[[list[str]], list], texts: list[str], tries: int = TRIES, wait: float = 0.0) -> list:
    """call's answers for a batch of texts; after `tries` failures none has one."""
    return attempted(call, texts, tries, wait)[0]


def model_result(text: Column | str, call: Callable[[list[str]], list], kind: T.DataType, tries: int = TRIES, at_once: int = 256, wait: float = 0.0, halve: bool = True) -> Column:
    """A column {answer, error} of a model's answers (vectors, summaries, rankings): the injected service is called in the executors with lists of at most at_once texts.

    A batch that fails is tried `tries` times. Then its halves are, and so on, so that a text that the service refuses
    doesn't spoil its neighbours; without `halve` all of the batch has failed. What fails has no answer, and the cause as its
    error. Null texts are not sent.
    """
    reachable(SparkSession.active())
    result = T.StructType([T.StructField("answer", kind), T.StructField("error", T.StringType())])

    def run(a: pa.Array) -> pa.Array:
        own, out = a.to_pylist(), [{"answer": None, "error": None}] * len(a)
        sent = [k for k, x in enumerate(own) if x is not None]
        parts = [sent[at : at + at_once] for at in range(0, len(sent), at_once)]
        while parts:
            part = parts.pop()
            answers, cause = attempted(call, [own[k] for k in part], tries, wait)
            if cause and halve and len(part) > 1:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            for k, answer in zip(part, answers):
                out[k] = {"answer": answer, "error": cause}
        return pa.array(out, _arrow(result))

    return F.arrow_udf(run, result)(text)


def model_call(text: Column | str, call: Callable[[list[str]], list], kind: T.DataType, tries: int = TRIES, at_once: int = 256, wait: float = 0.0) -> Column:
    """The answers of model_result alone; null where there is none."""
    return model_result(text, call, kind, tries, at_once, wait, halve=False)["answer"]


def keyed(texts: DataFrame) -> DataFrame:
    """texts (text, model) with their key in the cache; null texts have none and are left out."""
    return texts.where("text IS NOT NULL").select(F.md5("text").alias("md5"), "model", "text")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def model_alias(name: Column, default: str) -> Column:
    """The real model name of an alias; looked up and stored under it."""
    return F.when(name.isNull() | (name == "default"), F.lit(default)).otherwise(name)


def provider(area: Column, name: Column, default: str, regional: dict[int, tuple[str, str]]) -> Column:
    """(provider, model) of a request: an area with a provider of its own gets that one's model, all others the named one."""
    out = F.struct(F.lit("default").alias("provider"), model_alias(name, default).alias("model"))
    for code, (own, model) in regional.items():
        out = F.when(area == code, F.struct(F.lit(own).alias("provider"), F.lit(model).alias("model"))).otherwise(out)
    return out


class LookupCache:
    """Small lookups kept on the driver for a time: at most `live` seconds, and `idle` seconds after the last use."""

    def __init__(self, live: float = 259_200, idle: float = 1_800, clock: Callable[[], float] = time.monotonic, most: int = 10_000):
        self.live, self.idle, self.clock, self.most = live, idle, clock, most
        self._held: dict = {}

    def get(self, key, load: Callable):
        now, found = self.clock(), self._held.get(key)
        if found is not None and now - found[1] < self.live and now - found[2] < self.idle:
            self._held[key] = found[0], found[1], now
            return found[0]
        value = load(key)
        if len(self._held) >= self.most:
            self._held = {k: v for k, v in self._held.items() if now - v[1] < self.live and now - v[2] < self.idle}
            while len(self._held) >= self.most:
                del self._held[min(self._held, key=lambda k: self._held[k][2])]
        self._held[key] = value, now, now
        return value
