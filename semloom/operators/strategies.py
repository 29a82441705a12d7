"""How one semantic operator answers a batch of rows under each implementation."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..functions.chunks import as_text, split_evenly, top_chunks
from ..functions.parsing import parse_answer_json, parse_boolean, shape_many
from ..plans.physical import Implementation
from .provider import Completion, ModelProvider, Request


@dataclass
class Spent:
    """Calls, tokens, cost, seconds, failed calls and the first error of one row."""

    calls: int = 0
    input_tokens: float = 0.0
    output_tokens: float = 0.0
    cost: float = 0.0
    seconds: float = 0.0
    image_tokens: float = 0.0
    audio_tokens: float = 0.0
    failures: int = 0
    error: str | None = None

    def add(self, c: Completion, model: str) -> None:
        self.calls += 1
        self.input_tokens += c.input_tokens
        self.output_tokens += c.output_tokens
        self.cost += c.cost(model)
        self.seconds += c.seconds
        self.image_tokens += c.image_tokens
        self.audio_tokens += c.audio_tokens


def _ask(provider: ModelProvider, requests: list[Request], spent: list[Spent]) -> list[str | None]:
    """Replies in order; a failed request has none, and the others aren't asked again for it."""
    done = provider.complete_each(requests)
    for c, r, s in zip(done, requests, spent, strict=True):
        if isinstance(c, Exception):
            s.failures += 1
            s.error = s.error or f"{type(c).__name__}: {c}"[:500]
        else:
            s.add(c, r.model)
    return [None if isinstance(c, Exception) else c.text for c in done]


def _query(r: Request) -> str:
    return r.instruction if r.verb in ("filter", "join") else " ".join(f"{n} {d}" for n, d in r.fields)


def replies(provider: ModelProvider, impl: Implementation, requests: list[Request]) -> tuple[list[str | None], list[Spent]]:
    """The final reply of each request under the implementation, and what it took."""
    spent = [Spent() for _ in requests]
    if impl.kind in ("single", "nested"):
        return _ask(provider, [replace(r, model=impl.models[0]) for r in requests], spent), spent
    if impl.kind == "rag":
        size, keep = impl.get("size"), impl.get("keep")
        embed = lambda x: np.asarray(provider.embed(x, impl.get("embedder")))
        cut = [replace(r, model=impl.models[0], inputs={k: top_chunks(as_text(v), _query(r), size, keep, embed) if isinstance(v, (str, list)) else v for k, v in r.inputs.items()}) for r in requests]
        return _ask(provider, cut, spent), spent
    if impl.kind == "split":
        parts = []
        for i, r in enumerate(requests):
            pieces = {k: split_evenly(as_text(v), impl.get("chunks")) for k, v in r.inputs.items() if isinstance(v, (str, list)) and len(as_text(v)) >= impl.get("least")}
            for n in range(max([1, *map(len, pieces.values())])):
                parts.append((i, replace(r, model=impl.models[0], stage="propose" if pieces else "answer", inputs={k: (pieces[k][n] if n < len(pieces[k]) else "") if k in pieces else v for k, v in r.inputs.items()})))
        said = _ask(provider, [r for _, r in parts], [spent[i] for i, _ in parts])
        by_row: dict[int, list[str]] = {}
        for (i, _), text in zip(parts, said, strict=True):
            by_row.setdefault(i, []).append(text or "")
        many = [i for i, x in by_row.items() if len(x) > 1]
        merged = _ask(provider, [replace(requests[i], model=impl.models[0], stage="merge", prior=tuple(by_row[i])) for i in many], [spent[i] for i in many])
        out: list[str | None] = [by_row[i][0] for i in range(len(requests))]
        for i, text in zip(many, merged, strict=True):
            out[i] = text
        return out, spent
    if impl.kind == "mixture":
        rounds = [_ask(provider, [replace(r, model=m, stage="propose", temperature=impl.get("temperature", 0.0)) for r in requests], spent) for m in impl.models[:-1]]
        return _ask(provider, [replace(r, model=impl.models[-1], stage="aggregate", prior=tuple(x or "" for x in said)) for r, *said in zip(requests, *rounds, strict=True)], spent), spent
    if impl.kind == "critique":
        first = _ask(provider, [replace(r, model=impl.models[0]) for r in requests], spent)
        notes = _ask(provider, [replace(r, model=impl.models[1], stage="critique", prior=(a or "",)) for r, a in zip(requests, first, strict=True)], spent)
        return _ask(provider, [replace(r, model=impl.models[2], stage="refine", prior=(a or "", n or "")) for r, a, n in zip(requests, first, notes, strict=True)], spent), spent
    raise ValueError(f"no strategy {impl.kind!r}")


def verdicts(provider: ModelProvider, impl: Implementation, requests: list[Request]) -> tuple[list[bool | None], list[Spent]]:
    """True where the reply says so, None without a reply."""
    said, spent = replies(provider, impl, requests)
    return [None if x is None else bool(parse_boolean(x)) for x in said], spent


def judged(provider: ModelProvider, impl: Implementation, requests: list[Request]) -> tuple[list[bool], list[Spent]]:
    """True where the reply says so; a failure is False."""
    said, spent = verdicts(provider, impl, requests)
    return [bool(x) for x in said], spent


def extracted(provider: ModelProvider, impl: Implementation, requests: list[Request]) -> tuple[list[dict], list[Spent]]:
    """One record per request, missing fields None. Fields that a joint reply lacks are asked for one by one."""
    said, spent = replies(provider, impl, requests)
    out = []
    for r, text in zip(requests, said, strict=True):
        answer = parse_answer_json(text)
        out.append({n: answer.get(n) if isinstance(answer, dict) else None for n, _ in r.fields})
    if impl.kind == "single":
        again = [(i, f) for i, r in enumerate(requests) if len(r.fields) > 1 for f in r.fields if out[i][f[0]] is None]
        said = _ask(provider, [replace(requests[i], model=impl.models[0], fields=(f,)) for i, f in again], [spent[i] for i, _ in again])
        for (i, f), text in zip(again, said, strict=True):
            answer = parse_answer_json(text)
            out[i][f[0]] = answer.get(f[0]) if isinstance(answer, dict) else None
    return out, spent


def extracted_many(provider: ModelProvider, impl: Implementation, requests: list[Request]) -> tuple[list[list[dict]], list[Spent]]:
    said, spent = replies(provider, impl, requests)
    return [shape_many(parse_answer_json(t), [n for n, _ in r.fields]) for r, t in zip(requests, said, strict=True)], spent
