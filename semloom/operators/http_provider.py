"""A provider for models behind an HTTP interface of the common chat-completions form."""

from __future__ import annotations

import base64
import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from .provider import Completion, ModelProvider, Request


#: First bytes of the image formats that interfaces take, and their names.
_IMAGES = ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"RIFF", "image/webp"))


def _base64_of(form: str, value: str) -> str:
    """A file's bytes, or what is encoded already, as base64; files are read where the call is made."""
    if form == "base64":
        return value
    if "://" in value or value.startswith("file:"):
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(value)
        with files.open_input_stream(place) as f:
            return base64.b64encode(f.read()).decode()
    with open(value, "rb") as f:
        return base64.b64encode(f.read()).decode()


def content(request: Request) -> str | list[dict]:
    """The message's content: the prompt alone, or typed parts with it and all images and clips."""
    parts = []
    for _, kind, form, value in request.attached():
        if kind == "audio":
            parts.append({"type": "input_audio", "input_audio": {"data": _base64_of(form, value), "format": "wav"}})
        elif form == "url":
            parts.append({"type": "image_url", "image_url": {"url": value}})
        else:
            data = _base64_of(form, value)
            first = base64.b64decode(data[:16])
            name = next((n for mark, n in _IMAGES if first.startswith(mark)), "image/jpeg")
            parts.append({"type": "image_url", "image_url": {"url": f"data:{name};base64,{data}"}})
    return [{"type": "text", "text": request.prompt()}, *parts] if parts else request.prompt()


class HTTPProvider(ModelProvider):
    """Posts each request's prompt, with its images and clips as typed parts, to ``{base_url}/chat/completions``, and texts to ``{base_url}/embeddings``.

    ``names`` maps our model cards to the server's model names. Answers 408, 409, 429
    and 5xx and broken connections are tried again up to ``retries`` times, after the
    server's Retry-After or a doubling wait with jitter; anything else raises. A worker
    keeps up to ``parallel`` calls going, and starts no more than ``per_second`` of them.
    The key is read from the environment variable ``key_variable`` where the call is
    made, so it is never pickled. Calls have no side effects, so a task may repeat them.
    """

    AGAIN = (408, 409, 429, 500, 502, 503, 504)

    def __init__(self, base_url: str, names: dict[str, str] | None = None, key_variable: str = "", timeout: float = 60.0, retries: int = 4, parallel: int = 8, per_second: float | None = None, wait: float = 0.5, embed_batch: int = 128):
        self.base_url, self.names, self.key_variable = base_url.rstrip("/"), names or {}, key_variable
        self.timeout, self.retries, self.parallel, self.per_second = timeout, retries, parallel, per_second
        self.wait, self.embed_batch = wait, embed_batch
        self._start()

    def _start(self) -> None:
        self._lock, self._next = threading.Lock(), 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_lock", "_next")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _turn(self) -> None:
        """Wait for this call's turn under the rate."""
        if self.per_second:
            with self._lock:
                at = max(self._next, time.monotonic())
                self._next = at + 1 / self.per_second
            time.sleep(max(0.0, at - time.monotonic()))

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.key_variable and (key := os.environ.get(self.key_variable)):
            headers["Authorization"] = f"Bearer {key}"
        for attempt in range(self.retries + 1):
            self._turn()
            pause = self.wait * 2**attempt * random.uniform(0.5, 1.5)
            try:
                asked = urllib.request.Request(f"{self.base_url}/{path}", json.dumps(body).encode(), headers)
                with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code not in self.AGAIN or attempt == self.retries:
                    raise
                told = e.headers.get("Retry-After", "")
                pause = float(told) if told.replace(".", "", 1).isdigit() else pause
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
            time.sleep(pause)
        raise AssertionError("unreachable")

    def _one(self, request: Request) -> Completion:
        began = time.monotonic()
        body = {"model": self.names.get(request.model, request.model), "messages": [{"role": "user", "content": content(request)}], "temperature": request.temperature}
        reply = self._post("chat/completions", body)
        usage = reply.get("usage") or {}
        text = reply["choices"][0]["message"].get("content") or ""
        details = usage.get("prompt_tokens_details") or {}
        image, audio = (float(details.get(k) or 0) for k in ("image_tokens", "audio_tokens"))
        return Completion(text, float(usage.get("prompt_tokens") or 0), float(usage.get("completion_tokens") or 0), time.monotonic() - began, image, audio)

    def _tried(self, request: Request) -> Completion | Exception:
        try:
            return self._one(request)
        except Exception as e:  # another request's answer is still worth having
            return e

    def complete_each(self, requests: list[Request]) -> list[Completion | Exception]:
        if len(requests) == 1:
            return [self._tried(requests[0])]
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self._tried, requests))

    def complete(self, requests: list[Request]) -> list[Completion]:
        done = self.complete_each(requests)
        for c in done:
            if isinstance(c, Exception):
                raise c
        return done

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.embed_batch):
            reply = self._post("embeddings", {"model": self.names.get(model, model), "input": texts[i : i + self.embed_batch]})
            out += [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]
        return np.array(out, float).reshape(len(texts), -1)
