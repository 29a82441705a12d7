"""Model providers: what answers the requests of semantic operators.

A provider is pickled to the executors, so it must be serialisable, and idempotent,
since tasks may be retried. ``LocalProvider`` is deterministic and needs no network.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from ..plans.models import get_model


@dataclass(frozen=True)
class Request:
    """One call: the verb, its instruction, the fields asked for, the input fields, and what earlier calls said."""

    verb: str  # filter, join, map, flat_map, agg, judge
    instruction: str
    inputs: dict[str, Any] = field(default_factory=dict, hash=False)
    fields: tuple[tuple[str, str], ...] = ()  # name and description
    model: str = "local-large"
    stage: str = "answer"  # answer, propose, critique, refine, merge, aggregate
    prior: tuple[str, ...] = ()
    temperature: float = 0.0
    media: tuple[tuple[str, str, str], ...] = ()  # name, kind (image, audio) and form (path, base64, url) of the inputs that aren't text

    def attached(self) -> list[tuple[str, str, str, str]]:
        """Name, kind, form and value of each image and clip, in the fields' order; a field may hold several."""
        out = []
        for name, kind, form in self.media:
            value = self.inputs.get(name)
            out += [(name, kind, form, v) for v in (value if isinstance(value, list) else [value]) if v]
        return out

    def prompt(self) -> str:
        """The request as a prompt, trimmed to the model's context; images and clips are only named, since they are sent beside it."""
        inputs = {k: v for k, v in self.inputs.items() if k not in {m[0] for m in self.media}}
        inputs |= {name: f"[{kind} {sum(a[0] == name for a in self.attached())} attached]" for name, kind, _ in self.media}
        limit = get_model(self.model).context_chars if self.model else None
        while limit and sum(len(str(v)) for v in inputs.values()) > limit:
            longest = max(inputs, key=lambda k: len(str(inputs[k])))
            over = sum(len(str(v)) for v in inputs.values()) - limit
            inputs[longest] = str(inputs[longest])[: max(0, len(str(inputs[longest])) - over)]
        shape = {
            "filter": "Say TRUE if the record meets the condition, else FALSE.",
            "join": "Say TRUE if the two records meet the condition together, else FALSE.",
            "map": "Give one JSON object with the fields asked for.",
            "flat_map": "Give a JSON list of objects with the fields asked for.",
            "agg": "Give one JSON object with the field asked for, over all records.",
            "judge": "Give a score from 0 to 1.",
        }[self.verb]
        step = {
            "answer": "Answer from the record alone.",
            "propose": "Propose an answer; others propose too, and one will combine them.",
            "critique": "Name what is wrong or missing in the earlier answer, and how to mend it.",
            "refine": "Give the answer anew, mended by the earlier criticism.",
            "merge": "The earlier answers each saw a part of the record; combine them into one.",
            "aggregate": "The earlier answers are by other models; weigh them and give the best one.",
        }[self.stage]
        asked = "\n".join(f"- {n}: {d}" for n, d in self.fields)
        earlier = "\n".join(f"Earlier ({self.stage}): {p}" for p in self.prior)
        return f"{self.instruction}\n{shape} {step}\n{asked}\nRecord: {json.dumps(inputs, default=str, ensure_ascii=False)}\n{earlier}\nANSWER:"


@dataclass(frozen=True)
class Completion:
    text: str
    input_tokens: float = 0.0
    output_tokens: float = 0.0
    seconds: float = 0.0
    image_tokens: float = 0.0  # of the input tokens
    audio_tokens: float = 0.0

    def cost(self, model: str) -> float:
        card = get_model(model)
        text = self.input_tokens - self.image_tokens - self.audio_tokens
        image, audio = (card.usd_per_input_token if x is None else x for x in (card.usd_per_image_token, card.usd_per_audio_token))
        return text * card.usd_per_input_token + self.image_tokens * image + self.audio_tokens * audio + self.output_tokens * card.usd_per_output_token


class ModelProvider:
    """Answers batches of requests, and embeds texts.

    ``complete`` answers all requests or raises. Operators call ``complete_each``, which gives
    an exception in the place of each request that failed; as it stands, it hands on requests one by
    one, so that none is repeated because of another one's failure. Override it where several calls can run at once.
    """

    #: Tells providers apart in a request log that outlives a session; change it when answers would differ.
    log_name = ""

    def complete(self, requests: list[Request]) -> list[Completion]:
        raise NotImplementedError

    def complete_each(self, requests: list[Request]) -> list[Completion | Exception]:
        out: list[Completion | Exception] = []
        for r in requests:
            try:
                out += self.complete([r])
            except Exception as e:
                out.append(e)
        return out

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        raise NotImplementedError


def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """A unit vector of hashed lower-case words."""
    out = np.zeros(size)
    for w in re.findall(r"\w+", text.lower()):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[h[0] % size] += 1 if h[1] & 1 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


Rule = Callable[[dict], Any]


class LocalProvider(ModelProvider):
    """Answers by rules, the same on every machine.

    ``rules`` map an instruction (or a field's description) to a function of the
    input fields. Without a rule, a filter asks whether a quoted word of the
    instruction is in the inputs, and a field takes what its description's
    ``regex:`` pattern finds in them. ``errors`` makes small models err on a
    fixed share of inputs, by a hash, so that choices between models matter.
    """

    def __init__(self, rules: dict[str, Rule] | None = None, errors: bool = False):
        self.rules = rules or {}
        self.errors = errors

    def complete(self, requests: list[Request]) -> list[Completion]:
        return [self._one(r) for r in requests]

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        return np.array([hashed_vector(t) for t in texts]).reshape(len(texts), -1)

    def _wrong(self, r: Request) -> bool:
        if not self.errors or r.stage in ("refine", "aggregate"):
            return False
        seed = json.dumps([r.instruction, r.inputs, r.model], default=str, sort_keys=True)
        return hashlib.sha256(seed.encode()).digest()[0] / 256 > get_model(r.model).quality / 100

    def _one(self, r: Request) -> Completion:
        text = " ".join(str(v) for v in r.inputs.values() if v is not None)
        ruled = r.instruction in self.rules or any(x in self.rules for f in r.fields for x in f)
        if r.prior and r.stage in ("aggregate", "merge") and not ruled:
            reply = self._combine(r)
        elif r.verb in ("filter", "join"):
            rule = self.rules.get(r.instruction)
            quoted = re.findall(r"['\"]([^'\"]+)['\"]", r.instruction)
            good = bool(rule(r.inputs)) if rule else bool(quoted) and all(q.lower() in text.lower() for q in quoted)
            reply = f"ANSWER: {'TRUE' if good != self._wrong(r) else 'FALSE'}\n---"
        elif r.verb == "judge":
            reply = "ANSWER: 1.0\n---"
        else:
            whole = self.rules.get(r.instruction)
            answer = whole(r.inputs) if whole else {n: self._field(n, d, r.inputs, text) for n, d in r.fields}
            if self._wrong(r) and isinstance(answer, dict):
                answer = dict.fromkeys(answer)
            reply = f"ANSWER: {json.dumps(answer, default=str, ensure_ascii=False)}\n---"
        return Completion(reply, len(text) / 4 + len(r.instruction) / 4, len(reply) / 4, len(reply) / 4 * get_model(r.model).seconds_per_output_token)

    def _field(self, name: str, desc: str, inputs: dict, text: str) -> Any:
        rule = self.rules.get(desc) or self.rules.get(name)
        if rule:
            return rule(inputs)
        if desc.startswith("regex:"):
            m = re.search(desc[6:].strip(), text)
            return m[1] if m and m.groups() else m[0] if m else None
        return None

    def _combine(self, r: Request) -> str:
        """Chunks' answers merge (any true, first value found); models' answers are put to the vote."""
        from ..functions.parsing import parse_answer_json, parse_boolean

        if r.verb in ("filter", "join"):
            votes = [bool(parse_boolean(p)) for p in r.prior]
            good = any(votes) if r.stage == "merge" else sum(votes) * 2 > len(votes)
            return f"ANSWER: {'TRUE' if good else 'FALSE'}\n---"
        answers = [a for p in r.prior if (a := parse_answer_json(p)) is not None]
        if r.verb == "flat_map":
            rows = [x for a in answers for x in (a if isinstance(a, list) else [a])] if r.stage == "merge" else max(answers, key=lambda a: len(a) if isinstance(a, list) else 1, default=[])
            return f"ANSWER: {json.dumps(rows, default=str)}\n---"
        out = {n: next((a[n] for a in answers if isinstance(a, dict) and a.get(n) is not None), None) for n, _ in r.fields}
        return f"ANSWER: {json.dumps(out, default=str)}\n---"


class CachedProvider(ModelProvider):
    """Remembers replies by request within a process, up to ``size`` of them."""

    def __init__(self, inner: ModelProvider, size: int = 100_000):
        self.inner, self.size = inner, size
        self._known: dict[str, Completion] = {}

    def __getstate__(self):
        return {"inner": self.inner, "size": self.size}

    def __setstate__(self, state):
        self.inner, self.size, self._known = state["inner"], state["size"], {}

    @staticmethod
    def _key(r: Request) -> str:
        return json.dumps([r.verb, r.instruction, r.inputs, r.fields, r.model, r.stage, r.prior, r.temperature], default=str, sort_keys=True)

    def complete(self, requests: list[Request]) -> list[Completion]:
        keys = [self._key(r) for r in requests]
        new = {k: r for k, r in zip(keys, requests, strict=True) if k not in self._known}
        if len(self._known) + len(new) > self.size:
            self._known.clear()
            new = dict(zip(keys, requests, strict=True))
        self._known.update(zip(new, self.inner.complete(list(new.values())), strict=True))
        return [self._known[k] for k in keys]

    def complete_each(self, requests: list[Request]) -> list[Completion | Exception]:
        keys = [self._key(r) for r in requests]
        new = {k: r for k, r in zip(keys, requests, strict=True) if k not in self._known}
        if len(self._known) + len(new) > self.size:
            self._known.clear()
            new = dict(zip(keys, requests, strict=True))
        found = dict(zip(new, self.inner.complete_each(list(new.values())), strict=True))
        self._known.update({k: c for k, c in found.items() if not isinstance(c, Exception)})
        return [self._known[k] if k in self._known else found[k] for k in keys]

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        return self.inner.embed(texts, model)


def with_model(request: Request, **changes: Any) -> Request:
    return replace(request, **changes)
