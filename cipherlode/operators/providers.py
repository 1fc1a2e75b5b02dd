"""Code models that a run can ask: named providers, reached over HTTP from the tasks.

A provider is a function from a list of snippets to a list of answers, one for each. Those here ask a
server for one snippet at a time, several at once, within a time limit, again after a refusal or a pause that the
server asks for, and no faster than a rate. What fails stays a failed answer of its own row.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

TASK = "You find uses of cryptography in program code. Name the algorithm in capitals, its key length in bits and its mode, and tell whether it withstands quantum computers (Kyber, ML-KEM, Dilithium, ML-DSA, SLH-DSA and Falcon do). Reply with one JSON object only, with the fields algorithm (text), key_length (number or null), mode (text or null), is_pqc_safe (true or false) and confidence (0 to 1; 0.9 or more only where there is no doubt)."
AGAIN = (408, 409, 425, 429, 500, 502, 503, 504)


class Rate:
    """At most so many calls a second, over all threads of a task; 0 is no limit."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


@dataclass(frozen=True)
class Server:
    """How a provider is reached. rate: calls a second of one task; threads: calls at a time of one task."""

    provider: str
    base_url: str
    model: str
    api_key: str | None = None
    temperature: float = 0.3
    max_tokens: int = 500
    timeout: float = 30.0
    tries: int = 3
    pause: float = 1.0
    rate: float = 0.0
    threads: int = 4

    def question(self, snippet: str) -> tuple[str, dict]:
        """The path and body of a call."""
        asked = f"{TASK}\n\n```\n{snippet}\n```"
        if self.provider == "openai":
            return "/chat/completions", {"model": self.model, "messages": [{"role": "system", "content": TASK}, {"role": "user", "content": f"```\n{snippet}\n```"}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        if self.provider == "ollama":
            return "/api/generate", {"model": self.model, "prompt": asked, "stream": False, "format": "json", "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        return f"/models/{self.model}", {"inputs": asked, "parameters": {"max_new_tokens": self.max_tokens, "return_full_text": False}}

    def reply(self, body: dict | list) -> str:
        """The model's text in a server's answer."""
        if self.provider == "openai":
            return body["choices"][0]["message"]["content"] or ""
        if self.provider == "ollama":
            return body.get("response", "")
        return body[0].get("generated_text", "")

    def call(self, snippet: str, rate: Rate) -> str:
        path, body = self.question(snippet)
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), head)
        for left in range(self.tries - 1, -1, -1):
            rate.wait()
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return self.reply(json.load(answer))
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or not left:
                    raise
                after = e.headers.get("Retry-After", "")
                time.sleep(float(after) if after.isdigit() else self.pause * (self.tries - left))
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if not left:
                    raise
                time.sleep(self.pause * (self.tries - left))
        raise RuntimeError("no try was allowed")

    def __call__(self, snippets: list[str]) -> list[dict]:
        rate = Rate(self.rate)

        def one(snippet: str) -> dict:
            try:
                return parsed(self.call(snippet, rate))
            except Exception as e:
                return failed(f"{self.provider}: {type(e).__name__}: {e}")

        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(one, snippets))


def failed(why: str) -> dict:
    return {"success": False, "is_pqc_safe": False, "confidence": 0.0, "error": why}


def parsed(text: str) -> dict:
    """A model's reply: the JSON object from its first brace to its last."""
    try:
        v = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return failed("the reply holds no JSON object")
    number = lambda x, kind, other: kind(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1 << 31 else other
    text_of = lambda x: str(x) if x is not None else None
    return {"success": True, "algorithm": text_of(v.get("algorithm")), "key_length": number(v.get("key_length"), int, None), "mode": text_of(v.get("mode")), "is_pqc_safe": v.get("is_pqc_safe") is True, "confidence": number(v.get("confidence"), float, 0.5)}


# Where the providers are found.
ADDRESSES = {"openai": "https://api.openai.com/v1", "huggingface": "https://api-inference.huggingface.co", "ollama": "http://localhost:11434"}
NEEDS_KEY = ("openai", "huggingface")

_known: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """Make a provider known: make is called with a run's settings and gives a function of snippets."""
    _known[name] = make


def provider(settings) -> Callable | None:
    """The function of the settings' provider; None for the built-in mock. Refuses unknown and keyless ones."""
    name = settings.provider
    if name == "mock":
        return None
    if name in _known:
        return _known[name](settings)
    if name not in ADDRESSES:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted({'mock', *ADDRESSES, *_known}))}")
    if name in NEEDS_KEY and not settings.api_key:
        raise ValueError(f"provider {name} needs an API key")
    if not settings.model:
        raise ValueError(f"provider {name} needs a model")
    return Server(name, settings.base_url or ADDRESSES[name], settings.model, settings.api_key, settings.temperature, settings.max_tokens, settings.timeout, rate=settings.rate)
