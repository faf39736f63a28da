"""Byte-level BPE vocabularies: the merge list, the pre-token scanner and independent pieces.

A text is first cut at special strings.  A space between two other characters that are not
white space always starts a new pre-token, so what lies between such spaces (a *piece*) is
encoded independently of its neighbours, and repeated pieces are encoded once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import regex

# The contractions and character classes of the byte-level pre-tokenizer.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_BETWEEN_PIECES = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s |\s\Z| \s|\A ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Symbols are token ids; ``merges[i]`` = (left, right, made) is the pair of rank i."""

    byte_ids: list[int]
    merges: list[tuple[int, int, int]]
    token_bytes: dict[int, bytes]
    specials: dict[str, int]
    special_pattern: re.Pattern | None = field(compare=False, default=None)

    @cached_property
    def size(self) -> int:
        return max(self.token_bytes) + 1

    @cached_property
    def longest_token(self) -> int:
        """In bytes."""
        return max(map(len, self.token_bytes.values()))

    def segments(self, text: str) -> list[str | int]:
        """Plain text and the ids of special strings, in order."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [text] if text else []
        return [self.specials.get(s, s) for s in self.special_pattern.split(text) if s]


def pieces(text: str) -> list[str]:
    """The text cut at its single inner spaces; every piece but the first had one before it."""
    if _ODD_SPACE.search(text):
        return _BETWEEN_PIECES.split(text)
    return text.split(" ")


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    """Read the JSON of a byte-level BPE tokenizer; anything else in it is refused."""
    spec = json.loads(content)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"]
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    ids, characters = model["vocab"], byte_characters()
    byte_of = {c: b for b, c in enumerate(characters)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
    token_bytes |= {i: s.encode() for s, i in specials.items()}
    longest_first = sorted(specials, key=len, reverse=True)
    return Vocabulary(
        byte_ids=[ids[c] for c in characters],
        merges=[(ids[a], ids[b], ids[a + b]) for a, b in pairs],
        token_bytes=token_bytes,
        specials=specials,
        special_pattern=re.compile(f"({'|'.join(map(re.escape, longest_first))})") if specials else None,
    )


def vocabulary_file(name: str) -> bytes:
    """The bytes of a public vocabulary, read on the driver; tasks get them with their code."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()
