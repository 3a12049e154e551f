"""Text generators for revisions: a registry of callables, retries, mocks and a JSON-over-HTTP one.

The HTTP generator is registered by a caller, with its address; nothing here
sends text anywhere by itself.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass


class ProviderError(Exception):
    """Any failure of a provider."""


class AuthenticationError(ProviderError):
    pass


class RateLimitError(ProviderError):
    pass


class ProviderTimeout(ProviderError):
    pass


class InvalidResponseError(ProviderError):
    pass


class UnsupportedCapabilityError(ProviderError):
    pass


class ConfigurationError(ProviderError):
    pass


def is_retryable(error: Exception) -> bool:
    return isinstance(error, (RateLimitError, ProviderTimeout, ConnectionError, TimeoutError))


def with_retries(call: Callable[[], str], retries: int = 1, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """call(), again after delay * attempt seconds while its errors are retryable."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == retries or not is_retryable(error):
                raise
            sleep(delay * (attempt + 1))
    raise AssertionError


@dataclass(frozen=True)
class Capabilities:
    structured_output: bool = False
    streaming: bool = False
    system_messages: bool = False
    temperature: bool = False
    max_tokens: bool = False

    def output_kind(self) -> str:
        """How to ask for a structured answer; responses are parsed either way."""
        return "structured" if self.structured_output else "text-fallback"

    def checked(self, **options) -> dict:
        """The options, if all can be met."""
        if missing := sorted(k for k, v in options.items() if v is not None and not getattr(self, k, False)):
            raise UnsupportedCapabilityError(f"the provider lacks {', '.join(missing)}")
        return {k: v for k, v in options.items() if v is not None}


def post_json(url: str, payload: dict, headers: dict | None = None, timeout: float = 60.0):
    """The decoded answer to a POST of JSON; what goes wrong is one of this module's errors, and no text or header is named in it."""
    import socket
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        kind = {401: AuthenticationError, 403: AuthenticationError, 429: RateLimitError}.get(e.code, ProviderError)
        raise kind(f"the provider answered with status {e.code}") from e
    except (TimeoutError, socket.timeout) as e:
        raise ProviderTimeout("the provider didn't answer in time") from e
    except (urllib.error.URLError, ConnectionError) as e:
        if isinstance(getattr(e, "reason", None), TimeoutError):
            raise ProviderTimeout("the provider didn't answer in time") from e
        raise ProviderError(f"the provider can't be reached: {type(e).__name__}") from e
    except ValueError as e:
        raise InvalidResponseError("the provider's answer isn't JSON") from e


def http_provider(url: str, headers_from: dict[str, str] | None = None, timeout: float = 60.0, retries: int = 1, **options) -> Callable[[str], str]:
    """A generator that posts {"prompt": ..., **options} and reads text or content; header values come from the environment at call time."""
    import os

    def ask(prompt: str) -> str:
        headers = {}
        for name, variable in (headers_from or {}).items():
            if not os.environ.get(variable):
                raise ConfigurationError(f"the environment lacks {variable}")
            headers[name] = os.environ[variable]
        return with_retries(lambda: normalize_response(post_json(url, {"prompt": prompt, **options}, headers, timeout)), retries)

    return ask


def normalize_response(response) -> str:
    """The text of a string, of {"text": ...} or of {"content": [blocks]}."""
    if isinstance(response, str):
        return response
    if isinstance(response, dict):
        if isinstance(response.get("text"), str):
            return response["text"]
        if isinstance(response.get("content"), list):
            return "".join(b["text"] for b in response["content"] if isinstance(b, dict) and "text" in b)
    raise InvalidResponseError("response has no text")


def fixed(answer: str) -> Callable[[str], str]:
    return lambda prompt: answer


def echo(prompt: str) -> str:
    """The prompt's draft, unchanged."""
    found = re.search(r"DRAFT \(data\)\nBEGIN\n(.*)\nEND\Z", prompt, re.S)
    return found[1] if found else ""


def json_revision(edit: Callable[[str], str]) -> Callable[[str], str]:
    """A structured answer with the draft edited."""
    return lambda prompt: json.dumps({"revised_text": edit(echo(prompt)), "change_summary": []})


_REGISTRY: dict[str, Callable[..., Callable[[str], str]]] = {"mock": lambda: echo, "http": http_provider}


def register_provider(name: str, factory: Callable[..., Callable[[str], str]]) -> None:
    if not name or name in _REGISTRY:
        raise ConfigurationError(f"provider name is empty or taken: {name!r}")
    _REGISTRY[name] = factory


def get_provider(name: str, **options) -> Callable[[str], str]:
    if name not in _REGISTRY:
        raise ConfigurationError(f"unknown provider {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


def list_providers() -> list[str]:
    return sorted(_REGISTRY)
