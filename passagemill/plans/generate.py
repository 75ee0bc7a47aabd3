"""Replies of a language model, on the driver: a callable in, a parsed reply out, with one repair and bounded retries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from passagemill.functions.text import _first_object

Message = dict[str, str]
Model = Callable[[Sequence[Message], float, int], str]
#: Seconds before each attempt of a batch run.
WAITS = (0, 8, 20, 45)


class ModelError(RuntimeError):
    """A failure of the backend; ``code`` is one of auth, rate_limit, timeout, network, server."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(text or code)
        self.code = code


@dataclass
class Reply:
    answer: str = ""
    sources: list[str] = field(default_factory=list)
    refused: bool = False
    reason: str = ""
    raw: str = ""
    attempts: int = 0
    repaired: bool = False


def parse(raw: str) -> Reply:
    """The first JSON object of a text as a reply; an error if its fields have the wrong types."""
    found = _first_object(raw)
    if found is None:
        raise ValueError("no JSON object")
    value = json.loads(found)
    answer, sources = value.get("answer"), value.get("sources") or []
    if not isinstance(answer, str) or not isinstance(sources, list) or not all(isinstance(s, str) for s in sources):
        raise ValueError("wrong types")
    return Reply(answer.strip(), sources, bool(value.get("refused")), str(value.get("reason") or ""), raw)


def messages(question: str, blocks: str, rules: str = "Answer from the sources only, in at most three sentences, as JSON with answer, sources, refused and reason.") -> list[Message]:
    return [{"role": "system", "content": rules}, {"role": "user", "content": f"Sources:\n{blocks}\n\nQuestion: {question}"}]


def generate(model: Model, prompt: Sequence[Message], urls: Sequence[str] = (), temperature: float = 0.0, most: int = 250) -> Reply:
    """One reply; if it can't be parsed, exactly one more is asked for. Sources that were not retrieved are left out."""
    history = list(prompt)
    for attempt in (1, 2):
        raw = model(history, temperature, most)
        try:
            reply = parse(raw)
        except ValueError as e:
            if attempt == 2:
                return Reply(raw=raw, attempts=2, refused=True, reason=f"parse_failed: {e}")
            history += [{"role": "assistant", "content": raw}, {"role": "user", "content": "Send the same answer as one valid JSON object and nothing else."}]
            continue
        reply.sources = list(dict.fromkeys(s for s in reply.sources if s in set(urls)))
        reply.attempts, reply.repaired = attempt, attempt == 2
        return reply
    raise AssertionError


def with_waits(ask: Callable[[], Reply], sleep: Callable[[float], None] = time.sleep) -> Reply:
    """Ask again after errors of the backend, with longer waits; the last error is raised."""
    last: ModelError | None = None
    for wait in WAITS:
        if wait:
            sleep(wait)
        try:
            return ask()
        except ModelError as e:
            last = e
    raise last or ModelError("server")
