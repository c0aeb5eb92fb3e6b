"""Exact token counts of every prefix by dynamic programming over merge-rank encodings.

The encoding of a prefix is the encoding of a shorter prefix plus one last token that
no merge could join to the token before it; exactly one last token qualifies. So one
pass over a piece gives the last token and the count of each of its prefixes, and
running sums over the pieces carry the counts through the text. Whole-text counts,
truncation points and budget questions are look-ups in that table; nothing is
encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CACHE, Chunk, chunks

END = "</w>"


def _byte_symbols() -> list[str]:
    """Printable symbol of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts of all prefixes of a piece under a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab = model["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[a, b] = i
            self.made.setdefault(a + b, (i, a, b))
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.symbol = _byte_symbols()
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.counts: dict[int, int] = {}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Parts of a token on one edge, each with the rank at which it is merged away."""
        until, out = len(self.rank), []
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until = self.made[token][0]
            token = self.made[token][side]

    def _stay(self, a: str, b: str) -> bool:
        """Whether neighbours a, b stay two tokens: no merge across them comes before
        those that build them. At equal rank the left one comes first."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            if a not in self.right:
                self.right[a] = self._edge(a, 2)
            if b not in self.left:
                self.left[b] = self._edge(b, 1)
            get, most = self.rank.get, len(self.rank)
            known = self.apart[a, b] = not any(
                (m := get((x, y), most)) < most and m < px and m <= py for x, px in self.right[a] for y, py in self.left[b])
        return known

    def table(self, piece: str) -> list[int]:
        """Token count of each prefix of the piece that ends with a character, from 1 character on."""
        s = "".join(self.symbol[x] for x in piece.encode())
        last, inner = self._inner(s)
        ends = np.cumsum([len(c.encode()) for c in piece])
        return [self._final(s, int(k), last, inner) for k in ends]

    def count(self, piece: str) -> int:
        """Count of a whole piece. Only the prefixes that its last tokens ask for are filled in."""
        s = "".join(self.symbol[x] for x in piece.encode())
        if len(s) > 200:
            return self._final(s, len(s), *self._inner(s))
        known: dict[int, tuple[str, int]] = {0: ("", 0)}
        for j in range(max(0, len(s) - self.longest), len(s)):
            t = s[j:] + END
            if (j == len(s) - 1 or t in self.made) and (not j or self._stay(self._prefix(s, j, known)[0], t)):
                return known[j][1] + 1
        raise ValueError(f"no encoding of {s!r}")

    def _prefix(self, s: str, k: int, known: dict[int, tuple[str, int]]) -> tuple[str, int]:
        """Last token and count of the first ``k`` symbols, without a word end."""
        if k not in known:
            for j in range(max(0, k - self.longest), k):
                t = s[j:k]
                if (k - j == 1 or t in self.made) and (not j or self._stay(self._prefix(s, j, known)[0], t)):
                    known[k] = (t, known[j][1] + 1)
                    break
        return known[k]

    def _inner(self, s: str) -> tuple[list[str], list[int]]:
        last, n, vocab = [""], [0], self.made
        for k in range(1, len(s) + 1):
            for j in range(max(0, k - self.longest), k):
                t = s[j:k]
                if (k - j == 1 or t in vocab) and (not j or self._stay(last[j], t)):
                    last.append(t)
                    n.append(n[j] + 1)
                    break
        return last, n

    def _final(self, s: str, k: int, last: list[str], inner: list[int]) -> int:
        for j in range(max(0, k - self.longest), k):
            t = s[j:k] + END
            if (k - j == 1 or t in self.made) and (not j or self._stay(last[j], t)):
                return inner[j] + 1
        raise ValueError(f"no encoding of {s!r}")

    def of_chunk(self, c: Chunk) -> np.ndarray:
        """Token count of each piece of a chunk."""
        keys, first, at = np.unique(c.key, return_index=True, return_inverse=True)
        if len(self.counts) > CACHE:
            self.counts.clear()
        out = np.empty(len(keys), np.int64)
        for i, (k, p) in enumerate(zip(keys.tolist(), first.tolist())):
            n = self.counts.get(k)
            if n is None:
                piece = c.piece(p)
                n = self.counts[k] = 1 if piece in self.specials else self.count(piece)
            out[i] = n
        return out[at]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _tables(texts: list[str], pc: PrefixCounter) -> Iterator[tuple[int, Chunk, slice, np.ndarray]]:
    """For each text and chunk: its pieces and their counts."""
    for c in chunks(texts, "dropped", pc.specials):
        n = pc.of_chunk(c)
        cuts = np.flatnonzero(np.diff(c.owner, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield int(c.owner[lo]), c, slice(lo, hi), n[lo:hi]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Token counts of whole texts and the longest prefix within ``limit`` tokens.

    ``path`` names a word-end BPE vocabulary that every executor can open. Returns one
    row per input row: ``doc_id``; ``n_bytes`` (UTF-8); ``n_tokens`` as the tokenizer
    counts the whole text, without begin, end or other added tokens; ``over_limit``;
    ``limit_chars``, the characters of the longest prefix of the (NFC) text that has
    at most ``limit`` tokens, the whole text where it fits.

    Null texts count as empty (0 tokens); blank texts have 0 tokens; special tokens'
    strings inside a text count one token each; texts of any length count as a whole;
    doc_id is passed through, null or repeated, of any type; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        pc = counter(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            total, chars = np.zeros(len(texts), np.int64), np.array([len(x) for x in texts], np.int64)
            over = np.zeros(len(texts), bool)
            for i, c, where, n in _tables(texts, pc):
                grown = total[i] + np.cumsum(n)
                if grown[-1] > limit and not over[i]:
                    over[i] = True
                    p = int(np.searchsorted(grown, limit, side="right"))
                    room = limit - (grown[p - 1] if p else total[i])
                    piece = c.piece(where.start + p)
                    fits = [k for k, x in enumerate(pc.table(piece), 1) if x <= room] if piece not in pc.specials else []
                    chars[i] = c.offset[where.start + p] + c.start[where.start + p] + max(fits, default=0)
                total[i] = grown[-1]
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(total), pa.array(total > limit), pa.array(chars)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """The stored table itself: ``doc_id``, ``ends`` (characters at the end of each
    piece) and ``counts`` (exact tokens of the prefix that ends there)."""

    def run(batches):
        pc = counter(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ends: list[list[int]] = [[] for _ in texts]
            counts: list[list[int]] = [[] for _ in texts]
            for i, c, where, n in _tables(texts, pc):
                ends[i] += (c.offset[where] + c.end[where]).tolist()
                counts[i] += (np.cumsum(n) + (counts[i][-1] if counts[i] else 0)).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "ends", "counts"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, ends array<long>, counts array<long>")


def tokens_within(tables: DataFrame, budget: int) -> DataFrame:
    """Characters and tokens that fit a budget, read off stored tables."""
    fits = F.filter("counts", lambda c: c <= budget)
    return tables.select("doc_id", F.coalesce(F.try_element_at("ends", F.nullif(F.size(fits), F.lit(0))), F.lit(0)).alias("fit_chars"),
                         F.coalesce(F.array_max(fits), F.lit(0)).alias("fit_tokens"))
