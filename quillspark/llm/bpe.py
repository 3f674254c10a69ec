"""Worker-side byte-level BPE: cached pre-tokens and exact concatenation of encodings."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The byte-level pre-tokenizer's published pattern (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Outside of these code points Unicode versions may differ, and the library itself splits.
FAR = re.compile(r"[^\x00-ɏ]")
#: Pre-tokens at each end of a leaf that are kept apart; a join seldom looks behind them.
EDGE = 16
#: Pre-tokens over this many characters are encoded as a tree of halves.
PIECE_LEAF = 1024


def near_split() -> re.Pattern:
    """PRE_TOKEN for texts without FAR code points: with its classes as ranges, the standard engine takes a third of the time.

    No alternative but the contractions begins with an apostrophe and a letter, so the most frequent ones may come first.
    """
    import regex

    def ranges(kind: str) -> str:
        runs = regex.finditer(kind + "+", "".join(map(chr, range(0x250))))
        return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in runs)

    letter, number, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bpe:
    """One tokenizer file in one worker."""

    def __init__(self, path: str, cache_entries: int = 100_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = near_split().findall
        self.most = cache_entries
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.plain_special = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = self._alphabet()
        self.to_chars = "".join(alphabet)
        self.merged = self.tok.model.tokenize
        back = {c: b for b, c in enumerate(alphabet)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.id_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        self.id_chars: list[str] = [""] * len(self.id_bytes)
        for token, i in vocab.items():
            if token in self.special:
                self.id_bytes[i] = token.encode()
            else:
                self.id_bytes[i] = bytes(back[c] for c in token)
                self.id_chars[i] = token
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _alphabet() -> list[str]:
        """Byte to character, by the rule of byte-level BPE: printable Latin-1 stays, the rest follows from 256."""
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        extra = iter(range(256, 512))
        return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or not FAR.search(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Fill the cache with all of ``wanted``; half a cache that is full becomes the older half, from which what is still met comes back."""
        if len(self.cache) + len(wanted) > self.most // 2:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        for p in wanted:
            if p not in cache:
                ids = older.get(p)
                cache[p] = self.encoded(p) if ids is None else ids
        return cache

    def encoded(self, piece: str) -> bytes:
        """One pre-token: merges alone, which skips the library's way through a whole text."""
        ids = [t.id for t in self.merged(self.chars(piece))] if len(piece) <= PIECE_LEAF else self.tree(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def chars(self, piece: str) -> str:
        """The characters that stand for a piece's bytes."""
        return piece.encode().decode("latin-1").translate(self.to_chars)

    def raw(self, chars: str) -> list[int]:
        """Merges alone, over characters that stand for bytes."""
        return [t.id for t in self.merged(chars)]

    def tree(self, piece: str) -> list[int]:
        """Encode one unsplit piece: halves first, then the window around each join."""
        chars = self.chars(piece)
        level = [self.raw(chars[i : i + PIECE_LEAF]) for i in range(0, len(chars), PIECE_LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, a: list[int], b: list[int], k: int = 4) -> list[int]:
        """The encoding of two neighbouring parts of one piece.

        A sequence of tokens is the encoding of its text exactly if each neighbouring pair is.  A window
        whose first and last tokens come out as they were leaves only such pairs; else it grows.
        """
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self.raw("".join(map(self.id_chars.__getitem__, a[i:] + b[:j])))
            left = i == 0 or window[:2] == a[i : i + 2]
            right = j == len(b) or window[-2:] == b[max(0, j - 2) : j]
            if left and right:
                return a[:i] + window + b[j:]
            k *= 2

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [[""] if not t else self.at_special.split(t) if self.special and self.has_special(t) else [t] for t in texts]
        if not self.plain_special:
            split = [[t] if len(s) < 2 else None for t, s in zip(texts, split)]
        parts = [None if s is None else [x if x in self.special else self.pieces(x) for x in s if x] for s in split]
        ids = self.learn({p for s in parts if s for x in s if isinstance(x, list) for p in x}).__getitem__
        out = []
        for text, s in zip(texts, parts):
            if s is None:
                out.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif len(s) == 1 and isinstance(s[0], list):
                out.append(b"".join(map(ids, s[0])))
            else:
                out.append(b"".join(np.array([self.special[x]], "<u4").tobytes() if isinstance(x, str) else b"".join(map(ids, x)) for x in s))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.id_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    # Concatenation of encoded parts of a text that were cut anywhere.

    def edges(self, pieces: list[str], own: list[bytes]) -> bytes:
        """Characters and ids of each pre-token of a leaf, of a long one only of those at its ends."""
        if len(pieces) > 3 * EDGE:
            pieces, own = pieces[:EDGE] + pieces[-EDGE:], own[:EDGE] + own[-EDGE:]
        return np.array([[len(p) for p in pieces], [len(x) // 4 for x in own]], "<u4").tobytes()

    def part(self, text: str, ids: bytes, edges: bytes) -> list[tuple[str | None, list[int] | tuple[str, bytes]]]:
        """A leaf's pre-tokens with their ids; what is between the ends of a long leaf is one item (None, (leaf, ids))."""
        lengths, counts = np.frombuffer(edges, "<u4").reshape(2, -1).tolist()

        def run(lo: int, hi: int, at: int, first: int) -> list:
            out = []
            for size, n in zip(lengths[lo:hi], counts[lo:hi]):
                out.append((text[at : at + size], np.frombuffer(ids, "<u4", n, 4 * first).tolist()))
                at, first = at + size, first + n
            return out

        if sum(lengths) == len(text):
            return run(0, len(lengths), 0, 0)
        head, tail = sum(counts[:EDGE]), len(ids) // 4 - sum(counts[EDGE:])
        return [*run(0, EDGE, 0, 0), (None, (text, ids[4 * head : 4 * tail])), *run(EDGE, 2 * EDGE, len(text) - sum(lengths[EDGE:]), tail)]

    def opened(self, items: list) -> list:
        """Items with the pre-tokens of what is between the ends of leaves."""
        out = []
        for p, own in items:
            if p is None:
                inner = self.pieces(own[0])[EDGE:-EDGE]
                known = self.learn(set(inner))
                out += [(q, np.frombuffer(known[q], "<u4").tolist()) for q in inner]
            else:
                out.append((p, own))
        return out

    @staticmethod
    def flat(items: list) -> bytes:
        """The ids of all items."""
        return b"".join(own[1] if p is None else struct.pack(f"<{len(own)}I", *own) for p, own in items)

    def concat(self, a: list[tuple[str, list[int]]], b: list[tuple[str, list[int]]]) -> list[tuple[str, list[int]]]:
        """Two encoded parts as one: re-split a growing window around the join until both sides agree.

        A split depends on at most two characters behind a pre-token, so pre-tokens that end three
        characters before the join stay.  Where a boundary in the window meets one of the right part,
        all later ones are the same.  A pre-token that spans the join is joined token by token.
        """
        if not a or not b:
            return a or b
        if any(p is None for p, _ in a[-4:]):  # four pre-tokens have four characters
            a = self.opened(a)
        k = 3
        while k < len(a) and sum(len(p) for p, _ in a[len(a) - k :]) < 4:
            k += 1
        k = min(k, len(a))
        left, m = a[len(a) - k :], 2
        seam = sum(len(p) for p, _ in left)
        while True:
            right = b[:m]
            if any(p is None for p, _ in right):
                b = self.opened(b)
                right = b[:m]
            ends, at = {}, seam
            for n, (p, _) in enumerate(right[:-1] if m < len(b) else right):
                at += len(p)
                ends[at] = n + 1
            window = self.pieces("".join(p for p, _ in left + right))
            keep, used, at = [], None, 0
            for p in window:
                keep.append((at, p))
                at += len(p)
                if at in ends and (m < len(b) or ends[at] < len(b) or at == seam + sum(len(q) for q, _ in right)):
                    used = ends[at]
                    break
            if used is not None:
                return a[: len(a) - k] + [(p, self._ids(at, p, seam, left, right)) for at, p in keep] + b[used:]
            m *= 2

    def _ids(self, at: int, p: str, seam: int, left: list, right: list) -> list[int]:
        """Ids of a window's pre-token at offset ``at``; one made of two known neighbours at the seam is joined from them."""
        if len(p) > PIECE_LEAF and at < seam < at + len(p):
            last, first = left[-1], right[0]
            if last[0] + first[0] == p:
                return self.join(last[1], first[1])
        return np.frombuffer(self.learn({p})[p], "<u4").tolist()


_LOADED: dict[tuple, Bpe] = {}


def loaded(path: str, cache_entries: int = 100_000) -> Bpe:
    """One instance per worker and file: its cache lives as long as the worker."""
    key = (path, cache_entries)
    if key not in _LOADED:
        _LOADED[key] = Bpe(path, cache_entries)
    return _LOADED[key]
