"""A model behind an HTTP interface that streams its answer as server-sent events."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable

from .model import ModelBusy


class HttpClient:
    """A client for model.ask: posts messages and the answer's schema and puts the streamed pieces together.

    A server that is busy (429, 503) ends the run with ModelBusy; other errors are OSErrors, which the caller tries
    again. Where a model streams reasoning only, that is the answer.
    """

    def __init__(self, url: str, model: str, *, temperature: float = 0.3, timeout: float = 1800, key: str | None = None):
        self.url, self.model, self.temperature, self.timeout, self.key = url, model, temperature, timeout, key

    def __call__(self, messages: list[dict], schema: dict, most: int) -> dict:
        body = {"model": self.model, "messages": messages, "max_tokens": most, "temperature": self.temperature, "stream": True, "stream_options": {"include_usage": True}, "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}}
        headers = {"Content-Type": "application/json", "Accept": "text/event-stream"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return gathered(answer)
        except urllib.error.HTTPError as e:
            if e.code in (429, 503):
                raise ModelBusy(f"the model server is busy ({e.code})") from e
            raise


def events(lines: Iterable[bytes]) -> Iterable[dict]:
    """The JSON of each event; data that spans lines is put together, a blank line ends an event."""
    held: list[str] = []
    for raw in [*lines, b""]:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if line.startswith("data:"):
            held.append(line[5:].lstrip())
        elif not line and held:
            data, held = "\n".join(held), []
            if data != "[DONE]":
                yield json.loads(data)


def gathered(lines: Iterable[bytes]) -> dict:
    text, thought, finish, tokens = [], [], "stop", 0
    for event in events(lines):
        tokens = (event.get("usage") or {}).get("completion_tokens", tokens)
        for choice in event.get("choices") or []:
            delta = choice.get("delta") or {}
            text.append(delta.get("content") or "")
            thought.append(delta.get("reasoning_content") or "")
            finish = choice.get("finish_reason") or finish
    return {"text": "".join(text) or "".join(thought), "finish": finish, "tokens": tokens}
