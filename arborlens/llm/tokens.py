"""Token ids of whole texts by a public tokenizer file, with words encoded once.

A text is cut before every single blank that stands between two other characters. The two kinds of tokenizers known here
(``_kind``) never join characters across such a place, so the ids of a text are those of its parts, one after the other.
Parts are remembered, in two generations, so that common ones stay while rare ones go. A new part of Latin letters, also
when lower-cased, and signs goes to the library's model directly, others to the whole tokenizer. With any other kind of
tokenizer, texts are encoded as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Sequence

import numpy as np

REMEMBERED = 1 << 17  # parts of a generation, about 200 bytes each; beyond, it takes the place of the one before it
LONG_PART = 200  # longer parts are not remembered
BLOCK = 1 << 16  # characters of a part beyond which it is cut further

_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINES = re.compile(r"\S+(?:\n\S+)+")
_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"  # besides the blank and the line feed
_WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FINER = re.compile(r"(?<=\S)(?=\s\S)")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(f"[{_LETTERS}]+")
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII, without the apostrophe

# The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def parts_of(text: str) -> list[str]:
    """Parts of a text; all but the first have lost the blank they begin with."""
    odd = (
        "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in _BLANKS)
        or not text.isascii() and any(c in text for c in _WIDE_BLANKS))
    return _CUT.split(text) if odd else text.split(" ")


def _kind(path: str) -> str:
    """``bytes``: byte-level words with their blank; ``lower``: lower-cased words without it; else empty."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    before, model = rules["pre_tokenizer"] or {}, rules["model"]
    if model["type"] != "BPE" or model.get("dropout"):
        return ""
    if before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and rules["normalizer"] is None:
        return "bytes"
    steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
    splits = [x["type"] for x in before.get("pretokenizers", [])]
    return "lower" if steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and model["end_of_word_suffix"] else ""


class _Memory(dict):
    """Encoding of parts, worked out when first asked for; those asked for since the last turn, and those of before it."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        value = self.before.get(part)
        if value is None:
            value = self.encoder.part(self.lead, part)
        if len(part) <= LONG_PART:
            self[part] = value
        return value

    def turn(self, remembered: int) -> None:
        if len(self) > remembered:
            self.before.clear()
            self.before.update(self)
            self.clear()


class Encoder:
    """Encodes texts with the file at ``path``; ``offsets`` gives character spans in place of ids.

    ``remembered`` is for tasks that have memory to spare, or little; else it is ``REMEMBERED``.
    """

    def __init__(self, path: str, offsets: bool = False, remembered: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._offsets, self._by = self._tokenizer.model, offsets, _kind(path)
        self._first, self._later = _Memory(self, ""), _Memory(self, " ")
        self._signs: dict[str, bytes] = {}
        self._remembered = remembered or REMEMBERED

    def _whole(self, text: str) -> np.ndarray:
        if self._offsets:
            return np.array(self._tokenizer.encode_batch([text], add_special_tokens=False)[0].offsets, np.int64).reshape(-1, 2)
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _word(self, word: str) -> bytes:
        """A word of Latin letters, with its blank if it has one."""
        if word.isascii() and not self._offsets:
            shown = word.replace(" ", _SIGN[32]) if self._by == "bytes" else word.lstrip(" ").lower()
            return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()
        raw = (word if self._by == "bytes" else word.strip(" ").lower()).encode()
        shown = raw.decode("latin-1")
        tokens = self._model.tokenize(shown.replace(" ", _SIGN[32]) if shown.isascii() else shown.translate(_SIGN))
        if not self._offsets:
            return array("I", [t.id for t in tokens]).tobytes()
        spans, start = array("q"), 0
        at = None if len(raw) == len(word) else [i for i, c in enumerate(word) for _ in c.encode()]  # the character of each byte
        for token in tokens:
            end = start + len(token.value)
            spans.append(start if at is None else at[start])
            spans.append(end if at is None else at[end - 1] + 1)
            start = end
        return spans.tobytes()

    def part(self, lead: str, part: str) -> bytes:
        word = part.rstrip(_SIGNS)
        simple = word.isalpha() and (word.isascii() or _WORD.fullmatch(word))
        if simple and self._by == "lower" and (self._offsets or not word.isascii() and not _WORD.fullmatch(word.lower())):
            simple = False  # lower-casing made something else than letters, which is cut by the library's rules
        if simple:
            signs = part[len(word):]
            if not signs:
                return self._word(lead + word)
            more = self._signs.get(signs)
            if more is None:
                more = self._signs[signs] = self._whole(signs).tobytes()
            if self._offsets:
                more = (np.frombuffer(more, np.int64) + len(lead) + len(word)).tobytes()
            return (self._later if lead else self._first)[word] + more
        if "\n" in part and _LINES.fullmatch(part) and len(part) <= LONG_PART:
            return self._lines(lead, part.split("\n"))
        text, out, start = lead + part, [], 0
        for piece in _FINER.split(text) if len(text) > BLOCK else [text]:
            out.append(self._whole(piece) + (start if self._offsets else np.uint32(0)))
            start += len(piece)
        return np.concatenate(out).tobytes()

    def _lines(self, lead: str, pieces: list[str]) -> bytes:
        """Parts with single line feeds between them."""
        feed = self._signs.get("\n")
        if feed is None:
            feed = self._signs["\n"] = self._whole("\n").tobytes()
        raw, start = [(self._later if lead else self._first)[pieces[0]]], len(lead) + len(pieces[0])
        for piece in pieces[1:]:
            more = self._first[piece]
            if self._offsets:
                raw.append((np.frombuffer(feed, np.int64) + start).tobytes())
                raw.append((np.frombuffer(more, np.int64) + start + 1).tobytes())
                start += 1 + len(piece)
            else:
                raw += [feed, more]
        return b"".join(raw)

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32), or spans (int64, two columns), of each text; null counts as empty."""
        self._first.turn(self._remembered)
        self._later.turn(self._remembered)
        if len(self._signs) > self._remembered:
            self._signs.clear()
        later, out = self._later, []
        for text in texts:
            if not text or not self._by:
                out.append(self._whole(text or ""))
                continue
            parts = parts_of(text)
            raw = [self._first[parts[0]], *map(later.__getitem__, parts[1:])]
            out.append(_moved(raw, parts) if self._offsets else np.frombuffer(b"".join(raw), np.uint32))
        return out


def _moved(raw: list[bytes], parts: list[str]) -> np.ndarray:
    """Spans within parts as spans within the text."""
    spans = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    lengths[1:] += 1
    starts = np.cumsum(lengths) - lengths
    return spans + np.repeat(starts, np.fromiter(map(len, raw), np.int64, len(raw)) // 16)[:, None]


_encoders: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(path: str, offsets: bool = False, remembered: int | None = None) -> Encoder:
    """The encoder of this worker for a file."""
    key = (path, offsets, remembered)
    if key not in _encoders:
        _encoders[key] = Encoder(path, offsets, remembered)
    return _encoders[key]


def blocks(texts: list[str | None], characters: int = 1 << 20):
    """Runs of texts of a bounded size, as ``(start, end)``."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > characters:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)
