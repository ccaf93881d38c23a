"""Models behind the operators: what they must offer, and deterministic ones that need no network.

A provider is made in the worker by a function without arguments and called with a batch, so that a hosted model is asked in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64
#: Marks of the prompts, by which the extractive model finds its way.
CONTEXT_OPEN, CONTEXT_CLOSE, PASSAGE = "<contexto>", "</contexto>", "(pasaje "


#: A message has a role ("system" or "user") and a content.
Messages = list[dict[str, str]]


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TokenEmbedder(Protocol):
    def embed_tokens(self, texts: list[str]) -> list[np.ndarray]:
        """A matrix for each text, with a vector for each of its tokens; repeated tokens count again."""


class Chat(Protocol):
    def reply(self, conversations: list[Messages], temperature: float, most_tokens: int | None) -> list[str]: ...


class Tagger(Protocol):
    def __call__(self, text: str) -> list[dict]: ...


_SPLIT = re.compile(r"[\s.,;:()\[\]\"'¿?¡!]+")


def _bucket(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


class HashEmbedder:
    """Counts of hashed tokens."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in set(_SPLIT.split((t or "").lower())) - {""}:
                out[i, _bucket(w, self.dimension)] += 1
        return out.tolist()

    def embed_tokens(self, texts: list[str]) -> list[np.ndarray]:
        unit = np.eye(self.dimension)
        return [unit[[_bucket(w, self.dimension) for w in _SPLIT.split((t or "").lower()) if w]] if t else np.zeros((0, self.dimension)) for t in texts]


class LexiconTagger:
    """Finds the words and phrases of a lexicon (word, entity_group) in a text, whatever their case, at word edges; the longest at a place counts."""

    def __init__(self, lexicon: Iterable[tuple[str, str]]):
        self.groups = {w.lower(): g for w, g in lexicon if w}
        self.longest = max((len(w.split()) for w in self.groups), default=0)

    def __call__(self, text: str) -> list[dict]:
        words, out, i = list(re.finditer(r"[^\W_]+(?:-[^\W_]+)*", text)), [], 0
        while i < len(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                found = text[words[i].start() : words[i + n - 1].end()]
                if (group := self.groups.get(found.lower())) is not None:
                    out.append({"entity_group": group, "word": found, "start": words[i].start()})
                    i += n
                    break
            else:
                i += 1
        return out


class Extractive:
    """Answers with the sentence of the context that shares most words with the question, and judges by shared words.

    Reads what stands after the marks of the prompts in lectern.operators.answer and evaluate; without a shared word it declines.
    """

    def __init__(self, decline: str = ""):
        self.decline = decline

    @staticmethod
    def _words(t: str) -> set[str]:
        return {w for w in re.findall(r"\w+", t.lower()) if len(w) > 3}

    def _one(self, prompt: str) -> str:
        if "{score}" in prompt:
            a, b = (self._words(x) for x in (prompt.split("<A>")[-1].split("</A>")[0], prompt.split("<B>")[-1].split("</B>")[0]))
            return '{"score": %.3f}' % (len(a & b) / len(a) if a else 0.0)
        question = prompt.split("<Q>")[-1].split("</Q>")[0]
        context = prompt.split(CONTEXT_OPEN)[-1].split(CONTEXT_CLOSE)[0]
        asked = self._words(question)
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip() and not s.startswith(PASSAGE)]
        best = max(sentences, key=lambda s: len(self._words(s) & asked), default="")
        return best if best and self._words(best) & asked else self.decline

    def reply(self, conversations: list[Messages], temperature: float = 0.0, most_tokens: int | None = None) -> list[str]:
        return [self._one("\n".join(m["content"] for m in c)) for c in conversations]


def embedding(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(make().embed(s.fillna("").tolist()))

    return run(text)


def chat(user: Column, make: Callable[[], Chat], system: Column | None = None, temperature: float = 0.0, most_tokens: int | None = None) -> Column:
    """A struct (reply, error) of a model asked with a system message, if there is one, and a user message.

    If a batch fails its conversations are asked one by one, and one that fails then has no reply and tells why; the others go on. A null user message isn't asked.
    """

    @F.pandas_udf("reply string, error string")
    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        model = make()
        talks = [([{"role": "system", "content": a}] if a is not None else []) + [{"role": "user", "content": b}] if b is not None else None for a, b in zip(first, second)]
        at = [i for i, t in enumerate(talks) if t]
        replies, errors = [None] * len(talks), [None] * len(talks)

        def ask(some: list[int]) -> None:
            got = model.reply([talks[i] for i in some], temperature, most_tokens)
            if len(got) != len(some):
                raise ValueError(f"{len(got)} replies to {len(some)} conversations")
            for i, x in zip(some, got):
                replies[i] = x

        try:
            ask(at) if at else None
        except Exception:  # noqa: BLE001 - whatever a model raises
            for i in at:
                try:
                    ask([i])
                except Exception as e:  # noqa: BLE001
                    replies[i], errors[i] = None, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(F.lit(None).cast("string") if system is None else system, user)
