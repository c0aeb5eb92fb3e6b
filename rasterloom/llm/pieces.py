"""Pre-token pieces of texts, found for many texts at once with NumPy.

Tokenizers first cut a text into pieces (words with their space, numbers, runs of
symbols) and encode each piece on its own. Pieces repeat, so the operators hash every
piece, look distinct ones up in a bounded cache and hand only new ones to the
tokenizer. Hashes are 64-bit sums of a mixed code point times a power of its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # code points handled at a time
CACHE = 1_000_000  # distinct pieces a worker remembers

# Code points with the Unicode property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BREAK, BLANK, SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(7)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CUT = re.compile("(?<=[^" + "".join(map(re.escape, map(chr, WHITE))) + "])(?=[ \n])")
_MARKS = re.compile("[\u0300-\U0010ffff]")
_tables: dict = {}


def _kinds() -> np.ndarray:
    """Class of every code point, as the tokenizers' library has it: other versions of
    Unicode, such as Python's own, class some code points otherwise."""
    if "kinds" not in _tables:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        code = np.array([*range(0xD800), *range(0xE000, 0x40000)])  # no letters, numbers or blanks beyond
        text = "".join(map(chr, code))
        kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (lo, hi) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                kinds[code[lo:hi]] = kind
        kinds[32] = BLANK
        _tables["kinds"] = kinds
    return _tables["kinds"]


def _lower() -> np.ndarray:
    """Lower case of every code point that has one of one code point, as the library has it."""
    if "lower" not in _tables:
        from tokenizers.normalizers import Lowercase

        low, lower = np.arange(0x110000, dtype=np.uint32), Lowercase()
        code = [*range(1, 0xD800), *range(0xE000, 0x20000)]  # no cases beyond
        for at in range(0, len(code), 4096):
            part = code[at:at + 4096]
            for i, x in zip(part, lower.normalize_str("\0".join(map(chr, part))).split("\0"), strict=True):
                if len(x) == 1:
                    low[i] = ord(x)
        _tables["lower"] = low
    return _tables["lower"]


def _nfc(text: str) -> str:
    """NFC as the library has it; texts without a code point from U+0300 on are normalised."""
    if not _MARKS.search(text):
        return text
    from tokenizers.normalizers import NFC

    return NFC().normalize_str(text)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = 1 << int(n).bit_length()
        for name, base in (("pow", _BASE), ("back", _BACK)):
            x = np.full(size, base, _U)
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=_U)
    return _tables["pow"][:n], _tables["back"]


class Chunk:
    """Pieces of some texts: where they start and end in ``text``, whose they are, their hashes."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, owner: np.ndarray, offset: np.ndarray, key: np.ndarray):
        self.text, self.start, self.end, self.owner, self.offset, self.key = text, start, end, owner, offset, key

    def piece(self, i: int) -> str:
        return self.text[self.start[i]:self.end[i]]


def chunks(texts: list[str], rule: str, specials: list[str]) -> Iterator[Chunk]:
    """Pieces of whole texts in order. ``rule``: ``spaced`` keeps white space in the
    pieces (byte-level pattern), ``dropped`` lower-cases and drops it (word-end pattern)."""
    special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    held: list[tuple[int, int, str, bool]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        marked = special.split(text) if special and any(s in text for s in specials) else [text]
        for j, part in enumerate(marked):
            if rule == "dropped" and not j % 2:
                part = _nfc(part).replace("İ", "i̇")  # the one lower case of two code points
            for block in [part] if j % 2 else _blocks(part):
                if size and size + len(block) > CHUNK:
                    yield _cut(held, rule)
                    held, size = [], 0
                held.append((i, at, block, bool(j % 2)))
                size += len(block) + 1
                at += len(block)
    if held:
        yield _cut(held, rule)


def _blocks(text: str) -> Iterator[str]:
    """Very long texts in blocks, cut before a blank that follows a word: pieces never span that."""
    at = 0
    while len(text) - at > CHUNK and (m := _CUT.search(text, at + CHUNK)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def _cut(held: list, rule: str) -> Chunk:
    text = "\n".join(["", *(x[2] for x in held), ""])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum([0, *(len(x[2]) + 1 for x in held)])
    if rule == "dropped":
        code = _lower()[code]
        text = code.tobytes().decode("utf-32-le", "surrogatepass")
    kind = _kinds()[code]
    kind[stops] = BREAK
    for k, x in enumerate(held):
        if x[3]:
            kind[stops[k] + 1:stops[k + 1]] = SPECIAL
    prev = np.empty_like(kind)
    prev[0], prev[1:] = BREAK, kind[:-1]
    start = kind != prev
    white = (kind == BLANK) | (kind == SPACE)
    if rule == "spaced":
        was = (prev == BLANK) | (prev == SPACE)
        after = np.empty_like(white)
        after[:-1], after[-1] = ~white[1:] & (kind[1:] != BREAK), False
        # A run of blanks keeps all but its last; a last blank of one space joins what follows.
        start = np.where(white, ~was | after, start & (prev != BLANK) | (kind == BREAK) | (prev == BREAK))
    else:
        start |= kind == NUMBER
    for q in np.flatnonzero((code == 39) & start):
        n = _contraction(text, q, kind)
        if n:
            start[q + 1:q + n] = False
            start[q + n] = True
    at = np.flatnonzero(start)
    if not len(at):
        at = np.array([0])
    value = code.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0xA24BAED4963EE407)
    value ^= value >> _U(31)
    power, back = _powers(len(code))
    key = np.add.reduceat(value * power, at) * back[at]
    end = np.append(at[1:], len(code))
    key ^= (end - at).astype(_U) * _U(0x9FB21C651E98DF25)
    real = kind[at] != BREAK
    if rule == "dropped":
        real &= ~white[at]
    at, end, key = at[real], end[real], key[real]
    part = np.searchsorted(stops, at, side="right") - 1
    owner = np.array([x[0] for x in held], np.int64)[part]
    offset = np.array([x[1] for x in held], np.int64)[part] - stops[part] - 1  # place in its own text: offset + start
    return Chunk(text, at, end, owner, offset, key)


def _contraction(text: str, at: int, kind: np.ndarray) -> int:
    """Length of 's 't 're 've 'm 'll 'd at an apostrophe that begins a piece; else 0."""
    if kind[at] == SPECIAL:
        return 0
    one, two = text[at + 1:at + 2], text[at + 1:at + 3]
    n = 2 if one in ("s", "t") else 3 if two in ("re", "ve") else 2 if one == "m" else 3 if two == "ll" else 2 if one == "d" else 0
    return n if n and not (kind[at + 1:at + n] == SPECIAL).any() else 0
