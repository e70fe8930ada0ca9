"""Pre-tokens of byte-level vocabularies, and the parts of their files.

A text is cut at the strings of the added tokens (leftmost, then longest); what
lies between is cut by the public pattern of these vocabularies.
"""

from __future__ import annotations

import json
import re
from functools import cache

import regex

# The pattern and the byte alphabet that files of this kind assume.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printed ones for themselves, the
    others for the code points from 256 on."""
    rest = [b for b in range(256) if b not in _PRINTED]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _patterns(top: int):
    """PATTERN for texts of code points below ``top``.  The standard module scans
    explicit character classes faster than the other one does properties, so those
    are written out; the branches differ in their first character, which lets the
    commonest one stand first."""
    if top > 0x10000:
        return regex.compile(PATTERN)

    def members(kind: str) -> str:
        own = regex.compile(kind)
        return "".join(re.escape(c) for c in map(chr, (*range(min(top, 0xD800)), *range(0xE000, top))) if own.match(c))

    letter, number, space = (members(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


def _cut(text: str) -> list[str]:
    if text.isascii():
        return _patterns(0x80).findall(text)
    try:
        text.encode("latin-1")
        return _patterns(0x100).findall(text)
    except UnicodeEncodeError:
        wide = len(text.encode("utf-16-le")) > 2 * len(text)
        return _patterns(0x110000 if wide else 0x10000).findall(text)


class Splitter:
    """Cuts texts to pre-tokens; ``added``: the strings of added tokens, with ids."""

    def __init__(self, added: dict[str, int]):
        self.added = added
        longest = sorted(added, key=lambda s: (-len(s), s))
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def __call__(self, text: str) -> list[str]:
        """The pre-tokens in order, added tokens among them as they are."""
        if self.special is None or self.special.search(text) is None:
            return _cut(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            else:
                out += _cut(part)
        return out


def parse(file_text: str) -> dict:
    """The JSON of a byte-level BPE vocabulary file; others are refused."""
    own = json.loads(file_text)
    pre, model = own.get("pre_tokenizer") or {}, own["model"]
    flags = [a for a in own.get("added_tokens", []) if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) or own.get("normalizer") or flags or odd \
            or model.get("byte_fallback") or model.get("ignore_merges") \
            or (own.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE file without normalizer, prefix space and flagged added tokens is needed")
    return own


def added_tokens(own: dict) -> dict[str, int]:
    return {a["content"]: a["id"] for a in own.get("added_tokens", [])}
