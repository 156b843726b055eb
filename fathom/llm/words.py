"""Subword ids of whole texts by way of their words.

Tokenizers that drop white space split a text at it before anything else, so a text's ids are its words' ids in order.
A worker keeps the ids of the words it has met, and hands only new words to the tokenizer, all at once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np

from fathom.llm.common import held, on_one_thread

#: Words kept by a worker, about 200 bytes each. When full, all but those of the texts at hand are forgotten.
CACHED = 450_000
#: Longer texts are split at a space after about so many characters.
PART = 1 << 20


def parts(text: str, size: int = PART) -> Iterator[list[str]]:
    """The text's words, in lists of bounded size. Only plain white space cuts; empty words do no harm."""
    text = text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}) if len(text) > size else text.replace("\n", " ")
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut].split(" ")
        at = cut + 1
    yield text[at:].split(" ")


#: A word the fast path may take: letters whose lower case and normal form are themselves, then ASCII marks.
LETTERS, MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_encoder(tokenizer_json: str):
    """Ids of one lower-case piece, given as UTF-8, for byte-level vocabularies whose ids are in merge order; None for others.

    The end of a word is written as byte FF, which UTF-8 never has.
    """
    spec = json.loads(tokenizer_json)
    model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers") or []
    if model.get("end_of_word_suffix") != "</w>" or not any(x.get("type") == "Lowercase" for x in steps):
        return None
    import tiktoken

    added, letters, ranks = {x["content"] for x in spec["added_tokens"]}, byte_letters(), {}
    for token, number in model["vocab"].items():
        if token not in added:
            last = token.endswith("</w>") and token != "</w>"
            ranks[bytes(letters[c] for c in (token[:-4] if last else token)) + (b"\xff" if last else b"")] = number
    encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: array("I", encode(piece + b"\xff")).tobytes()  # as little-endian as numpy's own


class WordIds:
    """Ids of words as little-endian 32-bit strings."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED) -> None:
        on_one_thread()
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.known = Tokenizer.from_str(tokenizer_json), cached, {"": b""}
        self.piece, self.pieces = piece_encoder(tokenizer_json), {"": b""}

    def plain(self, words: list[str]) -> list[str]:
        """Learn the plain ones of the words, piece by piece; the others are returned."""
        if self.piece is None:
            return words
        if len(self.pieces) > self.cached // 2:
            self.pieces = {"": b""}
        rest, known, pieces, piece = [], self.known, self.pieces, self.piece
        for w in words:
            letters = w.rstrip(MARKS)
            if not (letters.isascii() and letters.isalpha() or LETTERS.fullmatch(letters)):
                rest.append(w)
                continue
            marks, letters = w[len(letters) :], letters.lower()
            if (a := pieces.get(letters)) is None:
                a = pieces[letters] = piece(letters.encode())
            if marks:
                if (b := pieces.get(marks)) is None:
                    b = pieces[marks] = piece(marks.encode())
                a += b
            known[w] = a
        return rest

    def learn(self, words: set[str]) -> None:
        missing = list(words - self.known.keys())
        if len(self.known) + len(missing) > self.cached:
            self.known = {w: self.known[w] for w in words if w in self.known} | {"": b""}
        missing = self.plain(missing)
        for i in range(0, len(missing), 20_000):
            some = missing[i : i + 20_000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, which = np.array(found.ids, "<u4"), np.array([-1 if w is None else w for w in found.word_ids], np.int64)
            if len(which) and (which.min() < 0 or np.any(which[1:] < which[:-1])):  # special tokens in a text belong to no word
                self.known.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
                continue
            ends, raw = np.searchsorted(which, np.arange(len(some) + 1)) * 4, ids.tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(some, ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, waiting, size = [], [], 0
        for t in texts:
            lists = list(parts(t)) if len(t) <= PART else None
            if lists is None:
                out += self._joined(waiting)
                waiting, size = [], 0
                out.append(b"".join(self._joined([p])[0] for p in parts(t)))
                continue
            waiting.append(lists[0])
            size += len(t)
            if size > 2 * PART:
                out += self._joined(waiting)
                waiting, size = [], 0
        return out + self._joined(waiting)

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        if not lists:
            return []
        words = set().union(*lists)
        if not words <= self.known.keys():
            self.learn(words)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in lists]


def word_ids(tokenizer_json: str) -> WordIds:
    """This worker's encoder for the tokenizer, kept between tasks."""
    return held(("words", hash(tokenizer_json)), lambda: WordIds(tokenizer_json))
