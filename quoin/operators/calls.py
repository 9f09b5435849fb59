"""Calls of outside models: an ordered chain of providers, spaced calls, and answers that are checked.

A provider is a function from messages to text; it raises RateLimited when its quota is used up. Nothing here raises:
what became of a call is a value, so that a table of calls gives a table of outcomes.

`ask` runs the calls of a table in lanes. A lane is one task that calls one after another, so the pause between two
calls of a provider is kept by one process; with more lanes each pauses the longer, and the total rate stays.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.sources.ledger import Ledger

Message = dict[str, str]
ANSWERED, LIMITED, BROKEN = "answered", "limited", "broken"
DONE, FAILED, QUOTA = "done", "failed", "quota"


class RateLimited(Exception):
    """A provider's quota is used up."""


class Invalid(ValueError):
    """An answer is not of the form that was asked for."""


@dataclass
class Limiter:
    """Says how long a provider must rest before its next call."""

    interval: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free_at: dict[str, float] = field(default_factory=dict)

    def rest(self, provider: str) -> None:
        now = self.clock()
        pause = max(0.0, self.free_at.get(provider, now) - now)
        self.free_at[provider] = now + pause + self.interval
        if pause:
            self.sleep(pause)


@dataclass(frozen=True)
class Attempt:
    provider: str
    outcome: str
    text: str = ""


@dataclass(frozen=True)
class Outcome:
    """`status` is done, failed, or quota where every provider's quota is used up."""

    status: str
    value: object = None
    provider: str | None = None
    error: str = ""


@dataclass(frozen=True)
class Providers:
    """Tried in this order; `interval` seconds pass between two calls of one, and a wrong answer is shown to them
    with its error `repairs` times."""

    chain: tuple[tuple[str, Callable[[list[Message]], str]], ...]
    interval: float = 0.0
    repairs: int = 1

    @staticmethod
    def named(names: str, known: dict[str, Callable[[list[Message]], str]], interval: float = 0.0) -> Providers:
        """From names between commas, in that order; all that are known where there are none."""
        wanted = [n for n in map(str.strip, names.split(",")) if n] or list(known)
        if missing := [n for n in wanted if n not in known]:
            raise KeyError(f"no such provider: {', '.join(missing)}")
        return Providers(tuple((n, known[n]) for n in wanted), interval)

    def attempts(self, messages: list[Message], limiter: Limiter) -> list[Attempt]:
        """Up to the first provider that answers."""
        made: list[Attempt] = []
        waiting = iter(self.chain)
        while (not made or made[-1].outcome != ANSWERED) and (candidate := next(waiting, None)):
            name, call = candidate
            limiter.rest(name)
            try:
                made.append(Attempt(name, ANSWERED, call(messages) or ""))
            except RateLimited as e:
                made.append(Attempt(name, LIMITED, str(e)))
            except Exception as e:  # a provider may raise anything: the next one's turn
                made.append(Attempt(name, BROKEN, f"{type(e).__name__}: {e}"))
        return made

    def text(self, messages: list[Message], limiter: Limiter | None = None) -> Outcome:
        made = self.attempts(messages, limiter or Limiter(self.interval))
        if made and made[-1].outcome == ANSWERED:
            return Outcome(DONE, made[-1].text, made[-1].provider)
        used_up = made and all(a.outcome == LIMITED for a in made)
        return Outcome(QUOTA if used_up else FAILED, error="; ".join(f"{a.provider}: {a.outcome} {a.text}" for a in made) or "no provider")

    def kept(self, messages: list[Message], check: Callable[[object], object], ledger: Ledger | None) -> Outcome | None:
        """What the ledger holds for these messages, if `check` still lets it through."""
        found = ledger.get(*(m["content"] for m in messages)) if ledger else None
        try:
            return Outcome(DONE, check(json.loads(unfenced(found["text"]))), found["provider"]) if found else None
        except ValueError:
            return None

    def checked(self, messages: list[Message], check: Callable[[object], object], limiter: Limiter | None = None, ledger: Ledger | None = None) -> Outcome:
        """An answer in JSON that `check` lets through; it raises ValueError for others. With a ledger it is kept at once,
        and a question that has an answer there is not asked again."""
        if found := self.kept(messages, check, ledger):
            return found
        limiter, wrong, asked = limiter or Limiter(self.interval), "", [m["content"] for m in messages]
        for _ in range(1 + self.repairs):
            got = self.text(messages, limiter)
            if got.status != DONE:
                return got
            try:
                value = check(json.loads(unfenced(str(got.value))))
                if ledger:
                    ledger.put({"provider": got.provider, "text": str(got.value)}, *asked)
                return Outcome(DONE, value, got.provider)
            except ValueError as e:
                wrong = str(e)
                messages = messages + correction(str(got.value), wrong)
        return Outcome(FAILED, error=f"still invalid: {wrong}")


def correction(answer: str, wrong: str, most: int = 600) -> list[Message]:
    return [{"role": "assistant", "content": answer}, {"role": "user", "content": f"Rejected: {wrong[:most]}"}]


def unfenced(text: str) -> str:
    """Without a code fence around it."""
    body = text.strip()
    if body.startswith("```"):
        body = body[3:].removeprefix("json")
    return body.removesuffix("```").strip()


def parsed(c: Column, schema: str) -> Column:
    """The same in the JVM: null where the JSON is bad."""
    return F.from_json(F.regexp_extract(c, r"(?s)^\s*(?:```(?:json)?)?(.*?)(?:```)?\s*$", 1), schema)


def instructed(system: str, form: dict) -> str:
    """A system prompt with the JSON Schema that answers have to match."""
    return f"{system}\n\nOutput format (JSON Schema):\n{json.dumps(form, ensure_ascii=False)}"


def ask(calls: DataFrame, providers: Providers, system: str, check: Callable[[object], object], value: str, lanes: int = 1, ledger: Ledger | None = None) -> DataFrame:
    """calls: key, user and order. One row for each: key, status, provider, error and value, a column of the given
    type, null but for done calls. A lane makes its calls in `order`; once all quotas are used up, it makes no more:
    the rest of its rows have the status quota, but for those that a ledger answers."""
    shape = f"key bigint, status string, provider string, error string, value {value}"
    names = [c.split()[0] for c in ("key", "status", "provider", "error", "value")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, over = Limiter(providers.interval * lanes), None
        for rows in frames:
            out = []
            for key, user in zip(rows["key"], rows["user"], strict=True):
                messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
                got = (providers.kept(messages, check, ledger) or over) if over else providers.checked(messages, check, limiter, ledger)
                over = got if got.status == QUOTA else over
                out.append((key, got.status, got.provider, got.error, got.value))
            yield pd.DataFrame(out, columns=names)

    dealt = calls.select("key", "user", "order").repartition(lanes, "key")
    return dealt.sortWithinPartitions("order").drop("order").mapInPandas(run, shape)
