"""Answers to prompts: a deterministic stand-in natively, models through injected generators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib import error, request

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import stripped

Generate = Callable[[str, str], str]

# The stand-in's texts.
PREFIX = "[Generated by MockLLM]: "
QUOTE = "According to the verified reference documents, "
REFUSAL = "Based on the provided documents, I do not have enough information to answer this question."


def mock_answer(user_prompt: Column | str = "user_prompt", prefix: str = PREFIX) -> Column:
    """Quotes the first three lines of the sources, up to 200 characters."""
    lines = F.split(F.col(user_prompt) if isinstance(user_prompt, str) else user_prompt, "\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("said"))

    def read(state: Column, line: Column) -> Column:
        head, rule = line.startswith("--- [Source"), line.startswith("=" * 41) | line.startswith("User Question:")
        inside = F.when(head, True).when(rule, False).otherwise(state["inside"])
        text = stripped(line)
        takes = inside & ~head & (text != "") & (F.size(state["said"]) < 3)
        return F.struct(inside.alias("inside"), F.when(takes, F.concat(state["said"], F.array(text))).otherwise(state["said"]).alias("said"))

    said = F.aggregate(lines, start, read)["said"]
    quote = F.array_join(said, " ")
    quote = F.when(F.length(quote) > 200, F.concat(F.substring(quote, 1, 200), F.lit("..."))).otherwise(quote)
    return F.when(F.size(said) > 0, F.concat(F.lit(prefix + QUOTE), quote, F.lit(" [Source 1]."))).otherwise(F.lit(prefix + REFUSAL))


def answered(load: Callable[[], Generate], system: str = "system_prompt", user: str = "user_prompt") -> Column:
    """Answers of a generator that each Python worker makes once."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for s, u in batches:
            yield pd.Series([model(a, b) for a, b in zip(s, u, strict=True)], dtype=object)

    return generate(system, user)


def hosted_model(name: str = "gemini-1.5-flash", api_key: str | None = None, max_tokens: int = 1024, temperature: float = 0.1) -> Column:
    """Needs the google-generativeai package and a network."""
    if not api_key:
        raise ValueError("an API key is needed")

    def load() -> Generate:
        import google.generativeai as client

        client.configure(api_key=api_key)
        settings = client.types.GenerationConfig(max_output_tokens=max_tokens, temperature=temperature)
        return lambda system, user: client.GenerativeModel(model_name=name, system_instruction=system, generation_config=settings).generate_content(user).text or ""

    return answered(load)


def local_server(name: str = "llama3:latest", host: str = "http://localhost:11434", max_tokens: int = 1024, temperature: float = 0.1, timeout: float = 120) -> Column:
    """A model server that answers at ``/api/generate``."""

    def load() -> Generate:
        def generate(system: str, user: str) -> str:
            body = {"model": name, "system": system, "prompt": user, "stream": False, "options": {"num_predict": max_tokens, "temperature": temperature}}
            asked = request.Request(f"{host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
            try:
                with request.urlopen(asked, timeout=timeout) as reply:
                    return json.load(reply).get("response", "")
            except error.URLError as e:
                raise ConnectionError(f"no model server at {host}: {e}") from e

        return generate

    return answered(load)
