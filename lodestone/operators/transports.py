"""Models behind small interfaces, with retries; deterministic stand-ins for tests.

An absent model raises; nothing here invents text.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np


@dataclass
class Embedded:
    vectors: list[list[float]]
    tokens: int = 0


@dataclass
class Generated:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    stop_reason: str | None = None
    model: str = ""
    first_token_ms: int | None = None  # where the transport streams


class EmbedTransport(Protocol):
    id: str
    model: str
    dims: int
    max_batch: int
    max_chars: int
    max_tokens: int

    def embed(self, texts: list[str], purpose: str) -> Embedded: ...


class LlmTransport(Protocol):
    id: str
    model: str

    def generate(self, system: str, user: str) -> Generated: ...


class HashTransport:
    """Vectors from word hashes: equal texts are equal, shared words bring texts closer."""

    id, model, max_batch, max_chars, max_tokens = "hash", "hash-v1", 64, 50_000, 8_192

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str], purpose: str) -> Embedded:
        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1 if h >> 60 & 1 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return Embedded(out, sum(len(t) // 4 for t in texts))


class ScriptedLlm:
    """Replies from a function of (system, user)."""

    id, model = "scripted", "scripted-v1"

    def __init__(self, reply: Callable[[str, str], str]) -> None:
        self.reply = reply

    def generate(self, system: str, user: str) -> Generated:
        text = self.reply(system, user)
        return Generated(text, len(system + user) // 4, len(text) // 4, "end", self.model)


class HttpLlm:
    """A chat-completions endpoint; address, model and key are parameters.

    ``stream`` yields the reply's pieces as they come; ``generate`` gathers them.
    """

    id = "http"

    def __init__(self, url: str, model: str, key: str, max_tokens: int = 8000, timeout: float = 90.0, region: str = "", streaming: bool = True) -> None:
        if not key:
            raise ValueError("a key is needed for this transport")
        self.url, self.model, self.key, self.max_tokens, self.timeout = url, model, key, max_tokens, timeout
        self.region, self.streaming = region, streaming
        self.last: Generated | None = None

    def _body(self, system: str, user: str) -> dict:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return {"model": self.model, "messages": messages, "temperature": 0, "max_tokens": self.max_tokens}

    def stream(self, system: str, user: str) -> Iterator[str]:
        """Pieces of the reply; ``last`` holds the whole afterwards."""
        began, first, pieces, stop, usage = time.monotonic(), None, [], None, {}
        body = self._body(system, user) | {"stream": True, "stream_options": {"include_usage": True}}
        for data in _events(self.url, self.key, body, self.timeout):
            usage = data.get("usage") or usage
            for choice in data.get("choices", ()):
                piece = (choice.get("delta") or {}).get("content") or ""
                stop = choice.get("finish_reason") or stop
                if piece:
                    first = int((time.monotonic() - began) * 1000) if first is None else first
                    pieces.append(piece)
                    yield piece
        self.last = Generated("".join(pieces), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), stop, self.model, first)

    def generate(self, system: str, user: str) -> Generated:
        if self.streaming:
            for _ in self.stream(system, user):
                pass
            return self.last
        data = _post(self.url, self.key, self._body(system, user), self.timeout)
        choice, usage = data["choices"][0], data.get("usage", {})
        return Generated(choice["message"]["content"] or "", usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), choice.get("finish_reason"), self.model)


class Rotating:
    """Several transports of one model, by region: each call goes to the next one, and a throttled one is passed over at the retry."""

    id = "rotating"

    def __init__(self, members: list) -> None:
        if not members:
            raise ValueError("at least one transport is needed")
        self.members, self.turn = members, 0
        self.model = members[0].model

    def __getattr__(self, name: str):
        """Limits and width are those of the first member."""
        if name in ("dims", "max_batch", "max_chars", "max_tokens"):
            return getattr(self.members[0], name)
        raise AttributeError(name)

    def _next(self):
        own = self.members[self.turn % len(self.members)]
        self.turn += 1
        self.region = getattr(own, "region", "")
        return own

    def generate(self, system: str, user: str) -> Generated:
        return self._next().generate(system, user)

    def embed(self, texts: list[str], purpose: str) -> Embedded:
        return self._next().embed(texts, purpose)


class HttpEmbed:
    """An embeddings endpoint that takes ``input`` and gives ``data[].embedding``; all limits are parameters."""

    def __init__(self, url: str, model: str, key: str, dims: int, max_batch: int = 64, max_chars: int = 50_000, max_tokens: int = 8_192, timeout: float = 60.0, region: str = "") -> None:
        if not key:
            raise ValueError("a key is needed for this transport")
        self.id, self.region = f"http:{model}", region
        self.url, self.model, self.key, self.dims, self.timeout = url, model, key, dims, timeout
        self.max_batch, self.max_chars, self.max_tokens = max_batch, max_chars, max_tokens

    def embed(self, texts: list[str], purpose: str) -> Embedded:
        data = _post(self.url, self.key, {"model": self.model, "input": texts, "purpose": purpose}, self.timeout)
        rows = sorted(data["data"], key=lambda r: r.get("index", 0))
        return Embedded([r["embedding"] for r in rows], data.get("usage", {}).get("prompt_tokens", 0))


def _open(url: str, key: str, body: dict, timeout: float):
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "content-type": "application/json"})
    try:
        return urllib.request.urlopen(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.read().decode("utf-8", "replace")[:400]) from e
    except urllib.error.URLError as e:
        raise e.reason if isinstance(e.reason, OSError) else ConnectionError(str(e.reason)) from e


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    with _open(url, key, body, timeout) as r:
        return json.load(r)


def _events(url: str, key: str, body: dict, timeout: float) -> Iterator[dict]:
    """The data of server-sent events, up to the one that says it is done."""
    with _open(url, key, body, timeout) as r:
        for line in r:
            text = line.decode("utf-8", "replace").strip()
            if text.startswith("data:"):
                data = text[5:].strip()
                if data == "[DONE]":
                    return
                yield json.loads(data)


class HttpError(RuntimeError):
    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"HTTP {status}: {body}")
        self.status = status


class DailyLimit(RuntimeError):
    """Waiting doesn't help today."""


RETRYABLE_NAMES = frozenset(
    "ThrottlingException TooManyRequestsException ServiceUnavailableException InternalServerException ModelNotReadyException "
    "ModelTimeoutException TimeoutError AbortError".split()
)
PERMANENT_NAMES = frozenset(
    "AccessDeniedException ValidationException ResourceNotFoundException UnrecognizedClientException SerializationException".split()
)


def is_retryable(error: Exception) -> bool:
    """Of a generation call: too many requests, server errors, time-outs and lost connections."""
    status = getattr(error, "status", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    return type(error).__name__ in RETRYABLE_NAMES or isinstance(error, (ConnectionError, TimeoutError))


def embed_error(error: Exception) -> str:
    """daily-ceiling, other (permanent) or throttle."""
    if re.search(r"(?i)tokens per day|daily.*(quota|limit)", str(error)):
        return "daily-ceiling"
    permanent = type(error).__name__ in PERMANENT_NAMES or getattr(error, "status", None) in (400, 401, 403, 404)
    return "other" if permanent else "throttle"


@dataclass
class CallEvent:
    """One wait, rejected call or region call; rows of the call_events table."""

    stage: str
    kind: str  # wait, rejected or region
    ms: int = 0
    reason: str = ""


Log = Callable[[CallEvent], None]


def generate(transport: LlmTransport, system: str, user: str, stage: str = "answer", attempts: int = 3, log: Log = lambda e: None, sleep: Callable[[float], None] = time.sleep, base: float = 0.5) -> Generated:
    """A reply, tried again after doubling waits where the error allows it."""
    for attempt in range(1, attempts + 1):
        began = time.monotonic()
        try:
            reply = transport.generate(system, user)
            if region := getattr(transport, "region", ""):
                log(CallEvent(stage, "region", int((time.monotonic() - began) * 1000), region))
            return reply
        except Exception as e:
            if not is_retryable(e):
                raise
            log(CallEvent(stage, "rejected", int((time.monotonic() - began) * 1000), type(e).__name__))
            if attempt == attempts:
                raise
            wait = base * 2 ** (attempt - 1)
            sleep(wait)
            log(CallEvent(stage, "wait", int(wait * 1000), type(e).__name__))
    raise AssertionError("unreachable")


def embed_batch(transport: EmbedTransport, texts: list[str], purpose: str, attempts: int = 8, log: Log = lambda e: None, sleep: Callable[[float], None] = time.sleep) -> Embedded:
    for attempt in range(attempts):
        began = time.monotonic()
        try:
            out = transport.embed(texts, purpose)
        except Exception as e:
            kind = embed_error(e)
            if kind == "daily-ceiling":
                raise DailyLimit(f"the daily limit of {transport.model} is used up") from e
            if kind != "throttle" or attempt == attempts - 1:
                raise
            log(CallEvent("embed", "rejected", int((time.monotonic() - began) * 1000), type(e).__name__))
            wait = min(2**attempt, 64)
            sleep(wait)
            log(CallEvent("embed", "wait", wait * 1000, type(e).__name__))
        else:
            if region := getattr(transport, "region", ""):
                log(CallEvent("embed", "region", int((time.monotonic() - began) * 1000), region))
            if len(out.vectors) != len(texts):
                raise ValueError(f"{transport.id} gave {len(out.vectors)} vectors for {len(texts)} texts")
            for i, v in enumerate(out.vectors):
                if len(v) != transport.dims:
                    raise ValueError(f"vector {i} has {len(v)} numbers where {transport.dims} are expected")
            return out
    raise AssertionError("unreachable")


def embed_all(transport: EmbedTransport, texts: list[str], purpose: str, batch: int = 64, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep, **retry) -> Embedded:
    """All vectors in order, with ``pause`` seconds between calls.

    A text over the model's limit of characters is refused before the first
    call; one that may pass its limit of tokens is warned of, as the model cuts it.
    """
    for i, t in enumerate(texts):
        if len(t) > transport.max_chars:
            raise ValueError(f"text {i} has {len(t)} characters; {transport.model} takes at most {transport.max_chars}")
    over = sum(token_estimate(t) > transport.max_tokens for t in texts)
    if over:
        warnings.warn(f"{over} of {len(texts)} texts may pass the {transport.max_tokens} tokens that {transport.model} reads; the rest of them is not seen", stacklevel=2)
    size = max(1, min(batch, transport.max_batch))
    vectors: list[list[float]] = []
    tokens = 0
    for at in range(0, len(texts), size):
        if at and pause:
            sleep(pause)
        out = embed_batch(transport, texts[at : at + size], purpose, sleep=sleep, **retry)
        vectors += out.vectors
        tokens += out.tokens
    return Embedded(vectors, tokens)


def token_estimate(text: str) -> float:
    """As ``functions.text.estimate_tokens``: 2.5 Hebrew characters a token, 4 others."""
    hebrew = len(re.findall("[\u0590-\u05ff]", text))
    return hebrew / 2.5 + (len(text) - hebrew) / 4


#: Factories by name; options are the constructor's.  More can be added by their users.
EMBED: dict[str, Callable[..., EmbedTransport]] = {"hash": HashTransport, "http": HttpEmbed}
LLM: dict[str, Callable[..., LlmTransport]] = {"http": HttpLlm}


def embed_transport(name: str, **options) -> EmbedTransport:
    if name not in EMBED:
        raise KeyError(f"unknown embedding transport {name}; known: {', '.join(sorted(EMBED))}")
    return _made(EMBED[name], name, options)


def llm_transport(name: str, **options) -> LlmTransport:
    if name not in LLM:
        raise KeyError(f"unknown language-model transport {name}; known: {', '.join(sorted(LLM))}")
    return _made(LLM[name], name, options)


def _made(factory: Callable, name: str, options: dict):
    """One transport, or a rotation where ``regions`` maps regions to addresses."""
    regions = options.pop("regions", None)
    try:
        if regions:
            return Rotating([factory(**(options | {"url": url, "region": region})) for region, url in regions.items()])
        return factory(**options)
    except TypeError as e:
        raise ValueError(f"transport {name}: {e}") from e
