"""Language models behind HTTP services or a local library, in the shapes that such services commonly take.

Addresses and keys are options; nothing is read from the environment.  A provider is
pickled to the executors and calls from there, one connection a call.
"""

from __future__ import annotations

import importlib.util
import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

#: Answers that mean: ask again later.
BUSY = (408, 429, 500, 502, 503, 504)


def post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    """A JSON answer to a JSON question.  What may pass on its own is a ConnectionError, which ``with_retries`` asks again for; a refusal is a ValueError."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        kind = ConnectionError if e.code in BUSY else ValueError
        raise kind(f"{url}: {e.code} {e.reason}") from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise ConnectionError(f"{url}: {e}") from e


@dataclass
class _Service:
    """What all services share: the model, where it is, and how long and how freely it answers."""

    model: str
    base_url: str
    key: str | None = field(default=None, repr=False)
    temperature: float = 0.0
    max_tokens: int = 4000
    timeout: float = 120.0

    def __post_init__(self) -> None:
        self.base_url = self.base_url.rstrip("/")

    def available(self) -> bool:
        """Whether the service answers at all."""
        try:
            with urllib.request.urlopen(self.base_url, timeout=5):
                return True
        except urllib.error.HTTPError:
            return True
        except (urllib.error.URLError, TimeoutError, OSError):
            return False

    def _messages(self, prompt: str, system_prompt: str | None) -> list[dict]:
        return [*([{"role": "system", "content": system_prompt}] if system_prompt else []), {"role": "user", "content": prompt}]


class OllamaProvider(_Service):
    """A server of local models: one prompt, one answer."""

    def __init__(self, model: str, base_url: str = "http://localhost:11434", **options) -> None:
        super().__init__(model, base_url, **options)

    def generate(self, prompt: str, system_prompt: str | None = None) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        return post(f"{self.base_url}/api/generate", body | ({"system": system_prompt} if system_prompt else {}), {}, self.timeout)["response"]


class ChatProvider(_Service):
    """A service of chat completions: the system prompt is the first message."""

    def generate(self, prompt: str, system_prompt: str | None = None) -> str:
        body = {"model": self.model, "messages": self._messages(prompt, system_prompt), "temperature": self.temperature, "max_tokens": self.max_tokens}
        answer = post(f"{self.base_url}/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        return answer["choices"][0]["message"]["content"]


class MessagesProvider(_Service):
    """A service of messages: the system prompt stands apart, the answer is a list of parts."""

    def generate(self, prompt: str, system_prompt: str | None = None) -> str:
        body = {"model": self.model, "messages": self._messages(prompt, None), "temperature": self.temperature, "max_tokens": self.max_tokens}
        answer = post(f"{self.base_url}/messages", body | ({"system": system_prompt} if system_prompt else {}), {"x-api-key": self.key} if self.key else {}, self.timeout)
        return "".join(part["text"] for part in answer["content"] if part.get("type", "text") == "text")


_pipelines: dict[str, object] = {}


class LocalProvider:
    """A model run in the worker by the transformers library, loaded once a worker."""

    def __init__(self, model: str, max_tokens: int = 4000) -> None:
        self.model, self.max_tokens = model, max_tokens

    def available(self) -> bool:
        return importlib.util.find_spec("transformers") is not None

    def generate(self, prompt: str, system_prompt: str | None = None) -> str:
        if self.model not in _pipelines:
            from transformers import pipeline

            _pipelines[self.model] = pipeline("text-generation", model=self.model)
        text = f"{system_prompt}\n\n{prompt}" if system_prompt else prompt
        return _pipelines[self.model](text, max_new_tokens=self.max_tokens, return_full_text=False)[0]["generated_text"]
