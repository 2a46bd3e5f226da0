"""Language models behind one batch interface: clients, a deterministic double, and prompts sent from DataFrames."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelError(RuntimeError):
    """A call that failed for good."""


class TransientError(ModelError):
    """A call that may succeed when repeated."""


#: Statuses of HTTP after which a call is repeated.
REPEATED = frozenset((408, 409, 429))


def error_text(body: str) -> str:
    """What an error reply says, whatever form it has."""
    try:
        data = json.loads(body)
    except ValueError:
        return body[:300]
    found = data.get("error", data.get("message", data)) if isinstance(data, dict) else data
    found = found.get("message", found) if isinstance(found, dict) else found
    return str(found)[:300]


def _post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        raise TransientError(str(e)) from e


class HttpModel:
    """A chat-completions service. `transport` (url, headers, body, timeout) -> (status, body) may be replaced; `sleep` too."""

    def __init__(self, base_url: str, model: str, key: str = "", attempts: int = 3, timeout: float = 120.0, transport: Callable = _post, sleep: Callable = time.sleep):
        self.url, self.model, self.key, self.attempts, self.timeout = f"{base_url.rstrip('/')}/chat/completions", model, key, attempts, timeout
        self.transport, self.sleep = transport, sleep

    def complete(self, system: str, user: str, image: bytes | None = None) -> str:
        content: object = user
        if image is not None:
            import base64

            content = [{"type": "text", "text": user}, {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}]
        body = json.dumps({"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(self.attempts):
            try:
                status, text = self.transport(self.url, headers, body, self.timeout)
                if status < 400:
                    return json.loads(text)["choices"][0]["message"]["content"]
                error: ModelError = (TransientError if status in REPEATED or status >= 500 else ModelError)(f"HTTP {status}: {error_text(text)}")
            except TransientError as e:
                error = e
            except (KeyError, IndexError, TypeError, ValueError) as e:
                raise ModelError(f"reply not understood: {e!r}") from e
            if not isinstance(error, TransientError) or attempt + 1 == self.attempts:
                raise error
            self.sleep(0.5 * 1.5**attempt)
        raise ModelError("no attempt")


class MockModel:
    """Answers by literal replacement of a lexicon, the longest terms first: labels, charts and repairs as JSON, prose as text.

    What holds no known term is marked. Faults that may be had: a number unit that is swapped (`flip_units`), replies cut to `truncate` characters, and errors for
    prompts whose text holds one of `fail_on`. The same for every prompt in any order, on any executor.
    """

    def __init__(self, lexicon: dict[str, str] | None = None, mark: str = "[译] ", flip_units: bool = False, truncate: int | None = None, fail_on: tuple[str, ...] = ()):
        self.lexicon, self.mark, self.flip_units, self.truncate, self.fail_on = dict(lexicon or {}), mark, flip_units, truncate, fail_on

    def say(self, text: str, extra: dict[str, str] | None = None) -> str:
        out = text
        for terms in (extra or {}, self.lexicon):
            for source in sorted(terms, key=lambda s: (-len(s), s)):
                out = out.replace(source, terms[source])
        return out if out != text or not re.search(r"[^\W\d_]", text) else self.mark + text

    def complete(self, system: str, user: str, image: bytes | None = None) -> str:
        if any(f in user for f in self.fail_on):
            raise ModelError("call failed on request")
        body = user[user.find("{") :] if "{" in user else ""
        try:
            asked = json.loads(body)
        except ValueError:
            asked = None
        if isinstance(asked, dict) and "cells" in asked:
            terms = asked.get("glossary") or {}
            return json.dumps({"translations": [{"r": c["r"], "c": c["c"], "text": self.say(c["text"], terms)} for c in asked["cells"]]}, ensure_ascii=False)
        if isinstance(asked, dict) and "charts" in asked:
            terms = asked.get("glossary") or {}
            return json.dumps({"charts": [{"i": c["i"], "caption": self.say(c["caption"], terms), "description": self.say(c["description"], terms)} for c in asked["charts"]]}, ensure_ascii=False)
        if "CURRENT TRANSLATION:\n" in user:
            pairs = [line[2:].split(" => ", 1) for line in user.splitlines() if line.startswith("- ") and " => " in line]
            text = user.split("CURRENT TRANSLATION:\n", 1)[1].rstrip("\n")
            absent = [t for s, t in pairs if t not in text]
            for source, target in pairs:
                text = text.replace(source, target)
            return json.dumps({"fixed": text + "".join(f" ({t})" for t in absent if t not in text)}, ensure_ascii=False)
        text = user.split("SOURCE:\n", 1)[1].removesuffix("\n---") if "SOURCE:\n" in user else user
        terms = dict(line[2:].split(" => ", 1) for line in user.split("SOURCE:\n", 1)[0].splitlines() if line.startswith("- ") and " => " in line)
        out = "\n\n".join(self.say(p, terms) for p in text.split("\n\n"))
        if self.flip_units:
            out = out.replace("million", "\0").replace("thousand", "million").replace("\0", "thousand")
        return out if self.truncate is None else out[: self.truncate]


MODELS: dict[str, Callable] = {"mock": MockModel}


def make_model(name: str = "auto", **options):
    """A model by name: "mock"; "openai-compat" (also "openai", "http"; base_url, model and key as options or in LEDGERLENS_BASE_URL, LEDGERLENS_MODEL and LEDGERLENS_API_KEY); "auto" is the service if a key is given, else the double."""
    known = {k: options.pop(k, None) or os.environ.get(f"LEDGERLENS_{v}", "") for k, v in (("base_url", "BASE_URL"), ("model", "MODEL"), ("key", "API_KEY"))}
    if name in MODELS and name != "auto":
        return MODELS[name](**options)
    if name == "auto" and not known["key"]:
        return MockModel(**options)
    if name not in ("auto", "openai-compat", "openai", "http"):
        raise ValueError(f"unknown model {name!r}; known: {', '.join([*sorted(MODELS), 'openai-compat', 'auto'])}")
    if not known["key"]:
        raise ValueError("a key is needed: set LEDGERLENS_API_KEY")
    return HttpModel(known["base_url"], known["model"], known["key"], **options)


def ask(df: DataFrame, model, system: str, prompt: str = "prompt") -> DataFrame:
    """df with `reply`, `error` (null or what failed) and `seconds`, from one call for each row; a null prompt is not sent. Rows meet the model in Arrow batches on the executors."""
    names = [f.name for f in df.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "reply string, error string, seconds double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors, seconds = [], [], []
            for text in batch[prompt]:
                began, reply, error = time.perf_counter(), None, None
                if text is not None:
                    try:
                        reply = model.complete(system, text)
                    except ModelError as e:
                        error = str(e)
                replies.append(reply)
                errors.append(error)
                seconds.append(time.perf_counter() - began)
            yield batch[names].assign(reply=pd.Series(replies, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index), seconds=seconds)

    return df.mapInPandas(run, schema)


def usage(calls: DataFrame) -> DataFrame:
    """One row for each step of calls (step, prompt, reply, error, seconds): n_calls, n_failed, characters sent and had back, seconds."""
    length = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    return calls.groupBy("step").agg(F.count("prompt").alias("n_calls"), F.count("error").alias("n_failed"), length("prompt").alias("sent"), length("reply").alias("received"), F.sum("seconds").alias("seconds"))
