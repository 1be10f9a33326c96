"""Decision points answered by a text model: a registry of providers, called on batches of prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.session import durable

Provider = Callable[[str], str | None]
_providers: dict[str, Callable[[], Provider]] = {}


def register(name: str):
    """Register a factory of providers; a provider answers a prompt with text, or None."""

    def add(factory: Callable[[], Provider]) -> Callable[[], Provider]:
        _providers[name] = factory
        return factory

    return add


def provider_names() -> list[str]:
    return sorted(_providers)


@register("silent")
def _silent() -> Provider:
    """Answers nothing, so that every decision falls back on its formula."""
    return lambda prompt: None


@register("echo_number")
def _echo_number() -> Provider:
    """Answers with the last number of the prompt: a stand-in for tests."""
    import re

    return lambda prompt: (re.findall(r"[0-9]+(?:\.[0-9]+)?", prompt) or [None])[-1]


@register("agreeable")
def _agreeable() -> Provider:
    """Keeps what it is shown: the numbers of all listed cases, and each score as it is. A stand-in for tests."""
    import re

    def answer(prompt: str) -> str | None:
        scores = re.findall(r"(?m)^C(\d+): .*, score ([0-9.]+)$", prompt)
        if scores:
            return "{" + ", ".join(f'"C{i}": {x}' for i, x in scores) + "}"
        kept = re.findall(r"(?m)^R(\d+): .* validity=([0-9.]+)$", prompt)
        if kept:
            return "{" + ", ".join(f'"R{i}": {x}' for i, x in kept) + "}"
        return ", ".join(re.findall(r"(?m)^(?:Path_)?(\d+): ", prompt)) or None

    return answer


def varied(base: str, name: str, lead: str) -> None:
    """Register a provider that puts the same questions in other words: `lead` before each prompt."""
    factory = _providers[base]
    _providers[name] = lambda: (lambda model: lambda prompt: model(f"{lead}\n{prompt}"))(factory())


def describe(provider: str) -> dict[str, object]:
    """Whether a provider is registered and answers at all."""
    try:
        _providers[provider]()("1")
        return {"provider": provider, "available": True}
    except Exception as e:  # any failure is what is asked about
        return {"provider": provider, "available": False, "error": repr(e)}


@dataclass(frozen=True)
class Kept:
    """A provider whose replies are kept in a folder that all executors see, so that a prompt is put to it once: by all
    decisions of a plan, and by a later run that names the same folder."""

    name: str
    path: str


STORED = "key string, provider string, vote int, reply string"


def _asked(prompts: DataFrame, provider: str, tries: int, pause: float) -> DataFrame:
    """(key, vote, reply) from (key, vote, prompt)."""
    factory = _providers[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(prompt: str) -> str | None:
            for i in range(tries):
                if i:
                    time.sleep(pause)
                try:
                    if (reply := model(prompt)) is not None:
                        return reply
                except Exception:  # a provider's failure is an empty answer
                    continue
            return None

        for b in batches:
            yield pd.DataFrame({"key": b["key"], "vote": b["vote"], "reply": [one(p) for p in b["prompt"]]})

    kind = prompts.schema["key"].dataType.simpleString()
    return prompts.select("key", "vote", "prompt").mapInPandas(run, f"key {kind}, vote int, reply string")


def stored(spark: SparkSession, kept: Kept) -> DataFrame:
    """STORED: the replies of the provider that the folder holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(kept.path).where(F.col("provider") == kept.name).dropDuplicates(["key", "vote"])


def ask(prompts: DataFrame, provider: str | Kept = "silent", tries: int = 2, votes: int = 1, pause: float = 0.0) -> DataFrame:
    """(query_id, vote, reply) from (query_id, prompt): each prompt `votes` times, tried again after `pause` seconds upon
    an exception or no answer; null when all tries fail.

    With Kept, prompts that the folder has no reply to are asked now, equal ones once, and their replies are added to it;
    the result is a table and never asks. A prompt without a reply is asked again by the next call.
    """
    rows = prompts.select("query_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote"))
    if isinstance(provider, str):
        return _asked(rows.withColumnRenamed("query_id", "key"), provider, tries, pause).withColumnRenamed("key", "query_id")
    spark = prompts.sparkSession
    rows = durable(rows.withColumn("key", F.sha2("prompt", 256)), "prompts")
    new = rows.select("key", "vote", "prompt").dropDuplicates(["key", "vote"]).join(stored(spark, provider).select("key", "vote"), ["key", "vote"], "left_anti")
    said = _asked(new, provider.name, tries, pause).where("reply is not null")
    said.select("key", F.lit(provider.name).alias("provider"), "vote", "reply").write.mode("append").parquet(provider.path)
    # written: in one plan Spark takes two reads of a folder as equal, though the folder has grown between them
    return durable(rows.join(stored(spark, provider), ["key", "vote"], "left").select("query_id", "vote", "reply"), "replies")
