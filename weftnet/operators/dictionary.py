"""Dictionaries of surface forms on the workers: small ones as they are, large ones in packed arrays and shards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

_HEAD = re.compile(r"\w+|[^\w\s]")
#: Words of texts whose lengths a worker remembers.
REMEMBERED = 200_000

Match = tuple[int, int, str]


def head_of(surface: str) -> str:
    """The first word or sign of a surface form."""
    return _HEAD.search(surface)[0]


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def heads_in(text: str) -> Iterator[tuple[int, str]]:
    """(place, word or sign) where a match may begin: never inside a word."""
    for m in _HEAD.finditer(text):
        at = m.start()
        if not (at and _is_word(text[at - 1]) and not _is_word(m[0][0])):
            yield at, m[0]


def ends_well(text: str, end: int) -> bool:
    """Whether a match may end there."""
    return end <= len(text) and not (end < len(text) and _is_word(text[end]))


def leftmost_longest(found: Iterable[Match]) -> Iterator[Match]:
    """Of matches by place and falling length, those that don't overlap, from left to right."""
    free = 0
    for m in found:
        if m[0] >= free:
            yield m
            free = m[1]


class Matcher:
    """A dictionary as lists of surfaces by their first word or sign, the longest first.

    forms: (surface, label). Case aside, a part of the text matches a surface if it has the surface's length and the same lower case, so that
    surfaces whose lower case is longer than they are are found too.
    """

    def __init__(self, forms: Iterable[tuple[str, str]], case_sensitive: bool):
        self.low = (lambda s: s) if case_sensitive else str.lower
        self.by_head: dict[str, dict[tuple[int, str], str]] = {}
        for surface, label in sorted(forms, key=lambda f: -len(f[0])):
            self.by_head.setdefault(self.low(head_of(surface)), {})[len(surface), self.low(surface)] = label

    def matches(self, text: str) -> list[Match]:
        """(start, end, label): from left to right, the longest at each place."""
        found, free = [], 0
        for at, head in heads_in(text):
            if at < free or (own := self.by_head.get(self.low(head))) is None:
                continue
            for (size, key), label in own.items():
                if ends_well(text, at + size) and self.low(text[at : at + size]) == key:
                    found.append((at, at + size, label))
                    free = at + size
                    break
        return found


def _digests(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(k, digest_size=8).digest() for k in keys), np.uint64)


def _entry(size: int, low: str) -> bytes:
    return b"%d:" % size + low.encode("utf-8", "surrogatepass")


class PackedDictionary:
    """A dictionary in sorted arrays, some 45 bytes and its characters a surface: a worker holds millions.

    First words lead to the lengths that surfaces beginning with them have; each length that ends well in the text gives a candidate, and
    a text's candidates are looked up together, by their digests and then byte by byte. Arrays of a part of the surfaces (a shard) find
    its matches only, so that shards of any dictionary can be run one after another, and their matches put together.
    """

    def __init__(self, forms: Iterable[tuple[str, str]], case_sensitive: bool):
        self.case_sensitive = case_sensitive
        entries = {_entry(len(s), self._low(s)): label for s, label in forms}
        lengths: dict[str, set[int]] = {}
        for surface, _ in forms:
            lengths.setdefault(self._low(head_of(surface)), set()).add(len(surface))
        self.labels = sorted(set(entries.values()))
        code = {label: i for i, label in enumerate(self.labels)}
        keys = list(entries)
        digests = _digests(keys)
        order = np.argsort(digests, kind="stable")
        self.digests = digests[order]
        self.label = np.array([code[label] for label in entries.values()], np.int32)[order]
        sizes = np.array([len(k) for k in keys], np.int64)[order]
        self.blob = b"".join(keys[i] for i in order)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])

        heads = list(lengths)
        digests = _digests(h.encode("utf-8", "surrogatepass") for h in heads)
        order = np.argsort(digests, kind="stable")
        self.heads = digests[order]
        own = [sorted(lengths[heads[i]], reverse=True) for i in order]
        self.lengths = np.array([n for o in own for n in o], np.int32)
        self.spans = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64)
        self._seen: dict[str, tuple[int, ...]] = {}

    def _low(self, s: str) -> str:
        return s if self.case_sensitive else s.lower()

    @property
    def nbytes(self) -> int:
        return len(self.blob) + sum(a.nbytes for a in (self.digests, self.label, self.begins, self.heads, self.lengths, self.spans))

    def _lengths(self, head: str) -> tuple[int, ...]:
        if (found := self._seen.get(head)) is None:
            digest = _digests([self._low(head).encode("utf-8", "surrogatepass")])[0]
            i = int(np.searchsorted(self.heads, digest))
            found = tuple(self.lengths[self.spans[i] : self.spans[i + 1]].tolist()) if i < len(self.heads) and self.heads[i] == digest else ()
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[head] = found
        return found

    def all_matches(self, text: str) -> list[Match]:
        """Matches that may overlap, by place and falling length."""
        spots = [(at, at + n) for at, head in heads_in(text) for n in self._lengths(head) if ends_well(text, at + n)]
        if not spots:
            return []
        keys = [_entry(b - a, self._low(text[a:b])) for a, b in spots]
        digests = _digests(keys)
        places = np.searchsorted(self.digests, digests)
        found = []
        for spot, key, digest, i in zip(spots, keys, digests.tolist(), places.tolist(), strict=True):
            while i < len(self.digests) and int(self.digests[i]) == digest:  # two keys of one digest stand side by side
                if self.blob[self.begins[i] : self.begins[i + 1]] == key:
                    found.append((*spot, self.labels[self.label[i]]))
                    break
                i += 1
        return found

    def matches(self, text: str) -> list[Match]:
        return list(leftmost_longest(self.all_matches(text)))
