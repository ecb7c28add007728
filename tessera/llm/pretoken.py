"""Token ids of whole texts from memoised parts: a text's ids are its parts' ids in a row, so each distinct part is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: The letters, numbers and white space of Latin-1, as the tokenizers' patterns class them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: The settings of a tokenizer file that mean one of the two patterns.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_LEVEL = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    BYTE_LEVEL | {"use_regex": False},
]
WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

SPACED = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|{ENDINGS}| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNSPACED = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|{ENDINGS}|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: Pre-tokens, and their bytes, that each of the two generations of a worker's memo holds about.
WORDS, WORD_BYTES = 300_000, 24 << 20

Split = Callable[[str], list[str] | None]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def spaced_split(text: str) -> list[str] | None:
    """Pre-tokens of a Latin-1 text by the byte-level pattern; None for other texts."""
    return SPACED.findall(text) if _latin(text) else None


def word_split(text: str) -> list[str] | None:
    """Pre-tokens of a Latin-1 text in lower case, white space dropped; None for other texts."""
    return UNSPACED.findall(text.lower()) if _latin(text) else None


class PartEncoder:
    """Ids of texts as little-endian bytes (``width`` each).

    ``split`` cuts a text into pre-tokens, or gives None for a text that has to be encoded whole. ``encode_words`` gives
    the ids of a list of pre-tokens, ``encode_text`` those of one text. Only pre-tokens not yet known are encoded; the
    memo is bounded in entries and bytes. Texts that hold one of the strings ``added``, in any
    case, are encoded whole: the tokenizer takes these out before it splits.
    """

    def __init__(self, encode_words, encode_text, split: Split, width: int = 2, added: tuple[str, ...] = ()):
        self.encode_words, self.encode_text, self.split = encode_words, encode_text, split
        self.added = tuple(a.lower() for a in added)
        # a run of characters without case in each of them: a text without any needs no second look
        marks = [max(re.findall(r"[^A-Za-z\x80-\U0010ffff]+", a), key=len, default="") for a in added]
        self.marks = tuple(dict.fromkeys(marks))
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _parts(self, text: str) -> list[str] | None:
        if any(m in text for m in self.marks):
            low = text.lower()
            if any(a in low for a in self.added):
                return None
        return self.split(text)

    def _learn(self, words: list[str]) -> None:
        """Bring the pre-tokens into the younger generation: from the older, where frequent ones stay known, else by encoding."""
        if len(self.words) > WORDS or self.held > WORD_BYTES:
            self.words, self.older, self.held = {}, self.words, 0
        missing = []
        for word in set(words).difference(self.words):
            value = self.older.get(word)
            if value is None:
                missing.append(word)
            else:
                self._put(word, value)
        for word, ids in zip(missing, self.encode_words(missing), strict=True):
            self._put(word, np.asarray(ids, self.kind).tobytes())

    def _put(self, word: str, value: bytes) -> None:
        self.words[word] = value
        self.held += len(word) + len(value)

    def one(self, text: str) -> bytes:
        words = self._parts(text)
        if words is None:
            return np.asarray(self.encode_text(text), self.kind).tobytes()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(text) for text in texts]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printed]
    return {b: chr(b) if b in printed else chr(256 + hidden.index(b)) for b in range(256)}


_encoders: dict[str, PartEncoder] = {}


def library_split(settings: dict) -> Split:
    """How the pre-tokens of a tokenizer file are found; files with other settings have their texts encoded whole."""
    pre = settings.get("pre_tokenizer") or {}
    if settings.get("normalizer") is None and pre == BYTE_LEVEL:
        return spaced_split
    if (settings.get("normalizer") or {}).get("normalizers") == WORD_NORMAL and pre.get("pretokenizers") == WORD_LEVEL:
        return word_split
    return lambda text: None


def library_encoder(path: str) -> PartEncoder:
    """Ids by the tokenizers library with its own settings: an added token's string gives its id. One a Python worker and file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            split = library_split(json.load(file))
        letters, merged = _byte_letters(), t.model.tokenize
        # a pre-token has only its merges to come: the model gives its ids without the pipeline around it
        _encoders[path] = PartEncoder(
            lambda words: [[x.id for x in merged(w.encode().decode("latin-1").translate(letters))] for w in words],
            lambda text: t.encode(text, add_special_tokens=False).ids,
            split,
            2 if t.get_vocab_size() <= 1 << 16 else 4,
            tuple(a.content for a in t.get_added_tokens_decoder().values()),
        )
    return _encoders[path]
