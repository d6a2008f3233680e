"""Model calls: what an embedder, an extractor and a judge must do, offline stubs, and an HTTP adapter.

The stubs are deterministic stand-ins of this library, not language models: results with them say nothing about one.
"""

from __future__ import annotations

import http.client
import json
import re
import threading
import urllib.parse
import zlib
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from lexweave.functions.similarity import jaro_winkler_arrays


#: Open connections of this process, by thread.
_connections = threading.local()


class Embedder(Protocol):
    """Vectors in the order of the texts, one batch per call."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """JSON ``{"entities": [...]}``. A role is given only where it stands next to the name; in doubt it is a reference."""

    def extract(self, text: str, budget: int) -> str: ...


class Judge(Protocol):
    """One (verdict, reason) per candidate, in order, without ids: "same" needs evidence, "unsure" a real lack of it."""

    def judge(self, mention: dict[str, Any], candidates: list[dict[str, Any]]) -> list[tuple[str, str]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashes of character trigrams, normalised."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            padded = f"  {(text or '').lower()} "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode())
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()


@dataclass(frozen=True)
class RuleExtractor:
    """Pairs of capitalised words are names; their last word tells the type."""

    def extract(self, text: str, budget: int) -> str:
        found = {}
        for m in re.finditer(r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)+)\b", text):
            kind = "court" if "Court" in m[1] else "organization" if m[1].split()[-1] in {"Inc", "Corp", "Bank", "Company"} else "person"
            found.setdefault(m[1], {"name": m[1], "type": kind, "candidate_role": "none", "textual_evidence": m[1], "confidence": "explicit"})
        return json.dumps({"entities": list(found.values())})


@dataclass(frozen=True)
class RuleJudge:
    """Same at a high name similarity, unsure at a middling one, else different."""

    same: float = 0.93
    unsure: float = 0.85

    def judge(self, mention: dict[str, Any], candidates: list[dict[str, Any]]) -> list[tuple[str, str]]:
        names = [c.get("name") or "" for c in candidates]
        scores = jaro_winkler_arrays([mention.get("name") or ""] * len(names), names)
        return [("same", "alike names") if s >= self.same else ("unsure", "similar names") if s >= self.unsure else ("different", "other names") for s in scores.tolist()]


@dataclass(frozen=True)
class HttpModel:
    """An embedder, extractor and judge behind a local chat server's HTTP interface with schema-constrained answers."""

    url: str
    model: str
    embedding_model: str = ""
    timeout: float = 300.0
    options: dict[str, Any] = field(default_factory=dict)

    def _post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        """One connection per process and thread is kept open; one that the server has closed is opened again."""
        place = urllib.parse.urlsplit(self.url)
        key = (place.scheme, place.netloc)
        known = _connections.__dict__.setdefault("open", {})
        while True:
            kept = known.pop(key, None)
            kind = http.client.HTTPSConnection if place.scheme == "https" else http.client.HTTPConnection
            connection = kept or kind(place.netloc, timeout=self.timeout)
            try:
                connection.request("POST", place.path.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
                answer = connection.getresponse()
                content = answer.read()
            except (http.client.HTTPException, OSError) as e:
                connection.close()
                if kept is None or isinstance(e, TimeoutError):
                    raise
                continue
            known[key] = connection
            if answer.status >= 400:
                raise OSError(f"the model's server answered {answer.status}: {content[:200].decode(errors='replace')}")
            return json.loads(content)

    def _chat(self, system: str, user: str, shape: dict[str, Any], budget: int) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "format": shape, "stream": False, "think": False, "options": {**self.options, "num_predict": budget}}
        return self._post("/api/chat", body)["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._post("/api/embed", {"input": texts, "model": self.embedding_model or self.model})["embeddings"]

    def extract(self, text: str, budget: int) -> str:
        from lexweave.operators.prompts import EXTRACTION, extraction_shape

        return self._chat(EXTRACTION, text, extraction_shape(), budget)

    def judge(self, mention: dict[str, Any], candidates: list[dict[str, Any]]) -> list[tuple[str, str]]:
        from lexweave.operators.prompts import JUDGMENT, judgment_shape

        content = json.loads(self._chat(JUDGMENT, mention["prompt"], judgment_shape(len(candidates)), 1000))
        return [(j["verdict"], j["reason"]) for j in content["judgments"]]
