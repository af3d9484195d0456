"""Secrets in texts: patterns, and a character network over every long token and what stands around it (operator 13)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, staged, table, whole

KINDS = ("assign", "access", "hex", "network")
#: The fewest labelled findings of the rarer class that the network learns from at all; with fewer than FEW in all, each is varied more often.
LEAST_LABELLED, FEW = 20, 2_000
#: Findings of a shard, on average, and of either class in it at least, the rarer class's being dealt to several shards for that.
SHARD, LEAST_OF_CLASS = 8_000, 500
#: Share of the held-out labelled secrets that each threshold must let through.
RECALL = 0.98
#: Characters of a candidate in a window, and of what stands before and behind it; longer candidates are learned from in pieces.
INSIDE, AROUND = 32, 16
WIDTH = INSIDE + 2 * AROUND
PIECE = 4 * INSIDE


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# Runs that are too short can't be part of a longer match of their kind, so that the least length may stand in the pattern.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
#: Parts of which every name has one, in lower case; and a table that leaves only the bytes of candidates.
_PARTS = ("passw", "secret", "token", "apikey", "api_key")
_LEFT = bytes(b if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_.=-") else 0x20 for b in range(256))

Span = tuple[str, int, int]


def _has_name(text: str) -> bool:
    low = text.lower()
    return any(part in low for part in _PARTS)


def _has_long_token(text: str) -> bool:
    """Whether there is a run of 16 characters that candidates are made of; access keys and hexadecimal secrets are such runs."""
    return max(map(len, text.encode("utf-8", "surrogatepass").translate(_LEFT).split()), default=0) >= 16


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of what the patterns find, by start and then kind: whole matches, leftmost and not overlapping for each kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if _has_name(text) else []
    if _has_long_token(text):
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, in a base span) of the tokens of 16 characters or more that may be secrets."""
    if not _has_long_token(text):
        return []
    begins = [a for _, a, _ in base]
    reach = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []
    found = []
    for m in _CANDIDATE.finditer(text):
        at = bisect_right(begins, m.end() - 1)  # the base spans that begin before the candidate's end
        found.append((*m.span(), at > 0 and reach[at - 1] > m.start()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(characters, first inside, end inside) of the windows that cover a candidate: each has INSIDE of its characters and AROUND on either side."""
    out = []
    for at in range(start, end, INSIDE):
        at = max(start, min(at, end - INSIDE))
        lead = min(at, AROUND)
        stop = min(end, at + INSIDE)
        out.append((" " * (AROUND - lead) + text[at - lead : stop + AROUND], AROUND, AROUND + stop - at))
    return out


# Classes of characters: 0 is none, each printable ASCII character has its own, all other characters of a kind share one.
_OTHER_LETTER, _OTHER = 96, 97
CLASSES = 98
#: The largest logit, in hundredths, and the steps of 1 in which parameters are summed.
MOST_LOGIT, STEPS = 5_000, 2**32


def encoded(own: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the windows' characters, and the first of the candidate's and the end of these."""
    codes, ends = np.zeros((len(own), WIDTH), np.uint8), np.zeros((len(own), 2), np.uint8)
    for i, (text, a, b) in enumerate(own):
        codes[i, : len(text)] = [ord(c) - 31 if " " <= c <= "~" else _OTHER_LETTER if c.isalpha() else _OTHER for c in text]
        ends[i] = a, b
    return codes, ends


def _side_by_side(x: np.ndarray, span: int) -> np.ndarray:
    """The `span` neighbours from each place on, one after another. Products with it are small ones, a row each, for which no threads start."""
    n, width, channels = x.shape
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, width - span + 1, span * channels), x.strides))


class CharacterNetwork:
    """Embedded characters, a convolution over them, its largest and mean responses, a hidden layer, one logit."""

    def __init__(self, seed: int = 13, embedded: int = 7, span: int = 5, filters: int = 16, hidden: int = 16):
        rnd = np.random.default_rng(seed)
        self.span, self.filters, self.channels = span, filters, embedded + 1
        shapes = {"embed": (CLASSES, embedded), "conv": (span * self.channels, filters), "conv_0": (filters,), "dense": (2 * filters, hidden), "dense_0": (hidden,), "out": (hidden,), "out_0": (1,)}
        self.p = {k: (rnd.normal(0, 0.5 if k == "embed" else np.sqrt(2 / s[0]), s) if not k.endswith("_0") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_flat(self, values: np.ndarray) -> CharacterNetwork:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.asarray(values[at : at + v.size], np.float32).reshape(v.shape)
            at += v.size
        return self

    def _forward(self, codes: np.ndarray, ends: np.ndarray) -> tuple:
        place = np.arange(WIDTH, dtype=np.uint8)
        inside = (place >= ends[:, :1]) & (place < ends[:, 1:])
        x = np.concatenate([self.p["embed"][codes], inside[..., None].astype(np.float32)], axis=2)
        columns = _side_by_side(x, self.span)
        answers = np.maximum(columns @ self.p["conv"] + self.p["conv_0"], 0)
        pooled = np.concatenate([answers.max(axis=1), answers.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ self.p["dense"] + self.p["dense_0"], 0)
        return columns, answers, pooled, hidden, hidden @ self.p["out"] + self.p["out_0"][0]

    def logits(self, codes: np.ndarray, ends: np.ndarray, block: int = 128) -> np.ndarray:
        """In hundredths, so that the batches they come in don't matter and each value can be counted."""
        z = np.concatenate([np.empty(0), *(self._forward(codes[i : i + block], ends[i : i + block])[-1] for i in range(0, len(codes), block))])
        return np.clip(np.round(100 * z), -MOST_LOGIT, MOST_LOGIT).astype(np.int64)

    def _gradients(self, codes: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        columns, answers, pooled, hidden, z = self._forward(codes, ends)
        n, at, f = answers.shape
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        dh = np.outer(dz, self.p["out"]) * (hidden > 0)
        dp = dh @ self.p["dense"].T
        da = np.repeat(dp[:, None, f:] / np.float32(at), at, axis=1)
        rows, cols = np.indices((n, f))
        da[rows, answers.argmax(axis=1), cols] += dp[:, :f]
        da *= answers > 0
        padded = np.pad(da, ((0, 0), (self.span - 1, self.span - 1), (0, 0)))
        back = self.p["conv"].reshape(self.span, self.channels, f)[::-1].transpose(0, 2, 1).reshape(-1, self.channels)
        dx = _side_by_side(padded, self.span) @ back
        embedded = self.channels - 1
        to = codes[..., None].astype(np.int64) * embedded + np.arange(embedded)
        de = np.bincount(to.ravel(), dx[..., :-1].ravel(), CLASSES * embedded).reshape(CLASSES, embedded)
        return {"embed": de, "conv": (columns.transpose(0, 2, 1) @ da).sum(axis=0), "conv_0": da.sum(axis=(0, 1)), "dense": pooled.T @ dh, "dense_0": dh.sum(axis=0), "out": hidden.T @ dz, "out_0": np.array([dz.sum()])}

    def fit(self, codes: np.ndarray, ends: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.004, seed: int | tuple = 13) -> CharacterNetwork:
        """Adam over shuffled batches; both classes weigh the same in all."""
        rnd = np.random.default_rng(seed)
        weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)).astype(np.float32)
        y = y.astype(np.float32)
        mean, square, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rnd.permutation(len(y))
            for i in range(0, len(y), batch):
                own = order[i : i + batch]
                t += 1
                for k, g in self._gradients(codes[own], ends[own], y[own], weight[own]).items():
                    g = g.astype(np.float32)
                    mean[k] += np.float32(0.1) * (g - mean[k])
                    square[k] += np.float32(0.001) * (g * g - square[k])
                    self.p[k] -= np.float32(rate) * (mean[k] / np.float32(1 - 0.9**t)) / (np.sqrt(square[k] / np.float32(1 - 0.999**t)) + np.float32(1e-8))
        return self


SHAPES = ("hex", "upper", "mixed", "letters")


def shape(token: str) -> str:
    """What a token is made of; each shape has a threshold of its own."""
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex"
    if re.fullmatch(r"[A-Z0-9]+", token):
        return "upper"
    return "mixed" if re.search(r"[0-9]", token) else "letters"


@dataclass
class Detector:
    """A fitted network, the scale and shift of its logits that calibrate them, and the least calibrated logit for each shape."""

    network: CharacterNetwork
    scale: float
    shift: float
    least: dict[str, float]
    recall: float  # on held-out labelled findings
    false_rate: float

    def logits(self, own: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated logits of windows."""
        return self.calibrated(self.network.logits(*encoded(own))) if own else np.empty(0)

    def calibrated(self, hundredths: np.ndarray) -> np.ndarray:
        return np.round(self.scale * (hundredths / 100) + self.shift, 4)

    def of_tokens(self, tokens: list[tuple[str, int, int]]) -> np.ndarray:
        """The calibrated logit of each (text, start, end): the largest of its windows, so that long tokens are seen whole."""
        all_windows, owner = [], []
        for i, (text, a, b) in enumerate(tokens):
            own = windows(text, a, b)
            all_windows += own
            owner += [i] * len(own)
        out = np.full(len(tokens), -np.inf)
        for at in range(0, len(all_windows), 8192):
            np.maximum.at(out, owner[at : at + 8192], self.logits(all_windows[at : at + 8192]))
        return out

    def finds(self, token: str, logit: float) -> bool:
        return logit >= self.least[shape(token)]


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _random_like(rnd: np.random.Generator, token: str) -> str:
    """A random token of about the same length, of another make: keys come in more alphabets than the patterns know."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet = (lower + upper + digits, lower + digits, upper + digits, lower + upper + digits + "+/", digits + "abcdef", lower + upper + digits + "-_")[rnd.integers(6)]
    size = int(np.clip(len(token) + rnd.integers(-8, 9), 16, 64))
    lead = ("", "", "", "sk_", "pk-live-", "key_", "xx.")[rnd.integers(7)]
    return (lead + "".join(alphabet[i] for i in rnd.integers(0, len(alphabet), size)))[: max(16, size)]


def _harmless(rnd: np.random.Generator, words: list[str]) -> str:
    """A long token of words or of plain numbers, as names, paths, addresses and dates are."""
    joint = ".-_/"[rnd.integers(4)]
    own = [words[i] for i in rnd.integers(0, len(words), 4)]
    kind = rnd.integers(4)
    if kind == 0:
        own = [w.capitalize() for w in own]
    token = ("" if kind == 1 else joint).join(own)
    if kind == 2:
        token += f"{joint}{rnd.integers(0, 2100)}"
    if kind == 3:
        token = f"{rnd.integers(1900, 2100)}-{rnd.integers(1, 13):02d}-{rnd.integers(1, 29):02d}{joint}{own[0]}{joint}{own[1]}"
    return token if len(token) >= 16 else token + joint + words[0] * (1 + 16 // max(1, len(words[0])))


Labelled = tuple[str, str, str, bool]

_SECRET, _HELD, _HALF, _COUNTED, _SURE = 1, 2, 4, 8, 16


@dataclass
class Shard:
    """Encoded examples of some findings: characters, the candidate's ends, marks (bits, see above), and the place in SHAPES."""

    codes: np.ndarray
    ends: np.ndarray
    marks: np.ndarray
    shapes: np.ndarray

    def to_bytes(self) -> dict[str, bytes]:
        return {f.name: getattr(self, f.name).tobytes() for f in fields(self)}

    @classmethod
    def from_bytes(cls, row: dict[str, bytes]) -> Shard:
        one = {f.name: np.frombuffer(row[f.name], np.uint8) for f in fields(cls)}
        return cls(one["codes"].reshape(-1, WIDTH), one["ends"].reshape(-1, 2), one["marks"], one["shapes"])

    def has(self, mark: int) -> np.ndarray:
        return self.marks & mark > 0

    def trained(self, flat: np.ndarray, own: np.ndarray, epochs: int, seed: tuple) -> np.ndarray:
        """Parameters after some epochs over the examples that are own, in steps."""
        network = CharacterNetwork().with_flat(flat)
        if own.any():
            network.fit(self.codes[own], self.ends[own], self.has(_SECRET)[own].astype(float), epochs, seed=seed)
        return np.round(network.flat().astype(float) * STEPS).astype(np.int64)


def examples(found: list[tuple[str, str, str, bool, bool]], more: int, seed: tuple) -> Shard:
    """The examples of a shard's findings (before, token, after, is a secret, is counted here).

    Each finding is an example as it stands, one for each window. Each secret gives three more, with a random token of another make in
    its own place and in the place of a harmless one, and itself there; each harmless one gives two with tokens of words and numbers;
    all that `more` times. Every third finding, with what it gives, is held out, and every other belongs to the second half.
    """
    found = sorted(found)
    rnd = np.random.default_rng(seed)
    words = sorted({w for before, _, after, *_ in found for w in re.findall(r"[a-z]{3,9}", before + after)}) or ["word"]
    plain = [(b, a) for b, _, a, secret, _ in found if not secret]
    texts: list[tuple[str, int, int]] = []
    marks: list[int] = []
    shapes: list[int] = []

    def add(before: str, token: str, after: str, mark: int, most: int | None = 1) -> None:
        own = windows(before + token + after, len(before), len(before) + len(token))[:most]
        texts.extend(own)
        marks.extend([mark | _SURE] * len(own))
        shapes.extend([SHAPES.index(shape(token))] * len(own))

    for before, token, after, secret, counted in found:
        digest_ = int(hashlib.sha256(f"{before}\x1f{token}\x1f{after}".encode("utf-8", "surrogatepass")).hexdigest(), 16)
        mark = _SECRET * secret | _HELD * (digest_ % 3 == 1) | _HALF * (digest_ // 3 % 2) | _COUNTED * counted
        add(before, token, after, mark, None)
        for _ in range(more if secret else 2 * more):
            if not secret:
                add(before, _harmless(rnd, words), after, mark)
                continue
            add(before, _random_like(rnd, token), after, mark)
            if plain:
                there = plain[rnd.integers(len(plain))]
                add(there[0], _random_like(rnd, token), there[1], mark)
                add(there[0], token, there[1], mark)
    shard = Shard(*encoded(texts), np.array(marks, np.uint8), np.array(shapes, np.uint8))
    held, secrets = shard.has(_HELD), shard.has(_SECRET)
    if not (held[secrets].any() and held[~secrets].any()):
        shard.marks = shard.marks & ~np.uint8(_HELD) | np.uint8(_HELD) * (np.arange(len(marks)) % 3 == 1).astype(np.uint8)
    return shard


class LocalShards:
    """One shard that the process holds."""

    number = 1

    def __init__(self, shard: Shard):
        self.shard = shard

    def summed(self, work: Callable[[int, Shard], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
        """Values of each key that work(number of the shard, shard) gives, summed over all shards."""
        keys, values = work(0, self.shard)
        found: dict[int, int] = {}
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            found[k] = found.get(k, 0) + v
        return found

    def changed(self, work: Callable[[Shard], Shard]) -> LocalShards:
        return LocalShards(work(self.shard))


class SparkShards:
    """A row for each shard; the tasks work on them, and Spark sums what they give."""

    def __init__(self, rows: DataFrame, number: int):
        self.rows, self.number = rows, number

    def summed(self, work: Callable[[int, Shard], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    keys, values = work(row["shard"], Shard.from_bytes(row))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["k", "v"])

        return {r["k"]: r["v"] for r in self.rows.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}

    def changed(self, work: Callable[[Shard], Shard]) -> SparkShards:
        schema = self.rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield pa.RecordBatch.from_pylist([{"shard": row["shard"], **work(Shard.from_bytes(row)).to_bytes()}], batch.schema)

        return SparkShards(staged(self.rows.mapInArrow(run, schema), "shards"), self.number)


def _averaged(shards: LocalShards | SparkShards, chosen: list[Callable[[Shard], np.ndarray]], epochs: int, rounds: int, seed: int) -> list[np.ndarray]:
    """Parameters of a network for each choice of examples: every shard goes on from the mean of all, which is taken after each round."""
    flats = [CharacterNetwork(seed).flat().astype(float) for _ in chosen]
    size = len(flats[0])
    if shards.number == 1:
        epochs, rounds = epochs * rounds, 1
    for r in range(rounds):

        def work(number: int, shard: Shard, r: int = r, flats: list[np.ndarray] = flats) -> tuple[np.ndarray, np.ndarray]:
            values = [shard.trained(flat, choose(shard), epochs, (seed, number, r)) for flat, choose in zip(flats, chosen, strict=True)]
            return np.arange(size * len(flats)), np.concatenate(values)

        sums = shards.summed(work)
        mean = np.array([sums[k] for k in range(size * len(flats))]) / STEPS / shards.number
        flats = list(mean.reshape(len(flats), size))
    return flats


def _sure(flats: list[np.ndarray]) -> Callable[[Shard], Shard]:
    """Marks as sure all secrets, and the harmless examples to which the network of the other half gives less than a chance of an eighth."""

    def work(shard: Shard) -> Shard:
        sure, half = shard.has(_SECRET), shard.has(_HALF)
        for own, flat in ((~half, flats[0]), (half, flats[1])):
            sure[own] |= CharacterNetwork().with_flat(flat).logits(shard.codes[own], shard.ends[own]) < -200
        return Shard(shard.codes, shard.ends, shard.marks & np.uint8(255 - _SURE) | np.uint8(_SURE) * sure.astype(np.uint8), shard.shapes)

    return work


def _fitted(shards: LocalShards | SparkShards, recall: float, seed: int) -> Detector:
    """A detector from the examples of all shards.

    What the patterns don't know may be a secret all the same: harmless examples that a network fitted on the other half of the findings
    gives a chance of an eighth are left out, and once more by networks without these. On the held-out findings, with what they give,
    logits are calibrated, and each shape's threshold is the largest that lets `recall` of its secrets through (of all, for shapes with
    fewer than ten), or, where that is above all harmless ones, half way down to these; all from the counts of every logit.
    """
    one = shards.number == 1
    for _ in range(2):
        halves = [lambda s: s.has(_SURE) & s.has(_HALF), lambda s: s.has(_SURE) & ~s.has(_HALF)]
        shards = shards.changed(_sure(_averaged(shards, halves, 1, 5 if one else 3, seed)))
    flat = _averaged(shards, [lambda s: s.has(_SURE) & ~s.has(_HELD)], 1, 12 if one else 6, seed)[0]

    def count(number: int, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        own = shard.has(_SURE) & shard.has(_HELD) & shard.has(_COUNTED)
        z = CharacterNetwork().with_flat(flat).logits(shard.codes[own], shard.ends[own])
        return np.unique(((z + MOST_LOGIT) * len(SHAPES) + shard.shapes[own]) * 2 + shard.has(_SECRET)[own], return_counts=True)

    counts = sorted(shards.summed(count).items())
    keys, n = np.array([k for k, _ in counts], np.int64), np.array([v for _, v in counts], np.int64)
    z, shapes, secret = keys // 2 // len(SHAPES) - MOST_LOGIT, keys // 2 % len(SHAPES), keys % 2 > 0
    detector = Detector(CharacterNetwork().with_flat(flat), *_calibrated(z / 100, secret.astype(float), n), {}, 0.0, 0.0)
    p = detector.calibrated(z)

    def least(own: np.ndarray) -> float:
        limit = p[own][np.searchsorted(np.cumsum(n[own]), np.floor((1 - recall) * n[own].sum()), side="right")]
        return float(min(limit, (limit + p[~secret].max()) / 2) if (~secret).any() else limit)

    for i, name in enumerate(SHAPES):
        own = secret & (shapes == i)
        detector.least[name] = max(0.0, least(own if n[own].sum() >= 10 else secret))
    found = np.array([v >= detector.least[SHAPES[i]] for v, i in zip(p, shapes, strict=True)])
    detector.recall, detector.false_rate = (float((n * found)[own].sum() / max(1, n[own].sum())) for own in (secret, ~secret))
    return detector


def _more(findings: int) -> int:
    return int(np.clip(FEW // findings, 1, 8))


def fit_detector(found: list[Labelled], recall: float = RECALL, seed: int = 13) -> Detector | None:
    """A detector from labelled findings (before, token, after, is a secret) at hand; None if either class has fewer than LEAST_LABELLED."""
    if min(sum(s for *_, s in found), sum(not s for *_, s in found)) < LEAST_LABELLED:
        return None
    return _fitted(LocalShards(examples([(*f, True) for f in found], _more(len(found)), (seed, 0))), recall, seed)


def _calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make logits, each seen n times, the likeliest log odds of the labels, by Newton steps; labels count as (n + 1) / (n + 2), so that odds stay finite."""
    a, b = 1.0, 0.0
    positive, negative = n[y > 0].sum(), n[y == 0].sum()
    y = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([z, np.ones_like(z)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        gradient = x @ (n * (p - y)) + 1e-3 * np.array([a - 1, b])
        curvature = (x * (n * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The places of a candidate's pieces, of PIECE characters but for shorter candidates; the last may overlap the one before it."""
    return [(max(start, min(at, end - PIECE)), min(end, at + PIECE)) for at in range(start, end, PIECE)]


def labelled_findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """before, token, after, secret: every distinct candidate of all texts in pieces, with its surroundings, and whether patterns call it a secret.

    Of those that they do, these are the pieces that overlap what patterns find, so that long tokens are not secret in whole for a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                for start, end, secret in candidates(text, base):
                    own = pieces(start, end)
                    if secret and len(own) > 1:
                        own = [(a, b) for a, b in own if any(x < b and y > a for _, x, y in base)]
                    rows += [(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], secret) for a, b in own]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["before", "token", "after", "secret"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "before string, token string, after string, secret boolean")
    return staged(found.distinct(), "findings")


def learned(findings: DataFrame, recall: float = RECALL, seed: int = 13) -> Detector | None:
    """fit_detector on a table of findings, all of them: tasks fit networks on shards of it, and Spark sums their parameters and counts.

    Findings are dealt to shards by a hash; those of a class with fewer than LEAST_OF_CLASS a shard go to several shards, and count for
    thresholds in one. None if either class has fewer than LEAST_LABELLED.
    """
    counts = {r["secret"]: r["n"] for r in findings.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if min(counts.get(True, 0), counts.get(False, 0)) < LEAST_LABELLED:
        return None
    number, more = -(-total // SHARD), _more(total)
    copies = {s: min(number, -(-LEAST_OF_CLASS * number // n)) for s, n in counts.items()}
    places = F.sequence(F.lit(0), F.when(F.col("secret"), copies[True] - 1).otherwise(copies[False] - 1))
    dealt = findings.select("*", F.explode(places).alias("copy"))
    shard = F.pmod(F.pmod(F.xxhash64("before", "token", "after", "secret"), F.lit(number)) + F.col("copy"), F.lit(number)).cast("long")
    schema = "shard long, " + ", ".join(f"{f.name} binary" for f in fields(Shard))

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        own = zip(*(rows.column(c).to_pylist() for c in ("before", "token", "after", "secret", "counted")), strict=True)
        one = examples(list(own), more, (seed, key[0].as_py()))
        return pa.Table.from_pylist([{"shard": key[0].as_py(), **one.to_bytes()}], pa.schema([("shard", pa.int64()), *((f.name, pa.binary()) for f in fields(Shard))]))

    rows = dealt.select("before", "token", "after", "secret", (F.col("copy") == 0).alias("counted"), shard.alias("shard")).repartition(number, "shard")
    made = staged(rows.groupBy("shard").applyInArrow(make, schema), "shards")
    return _fitted(SparkShards(made, made.count()), recall, seed)


def find_secrets(docs: DataFrame, detector: Detector | None, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_network (long), base_sha256, spans, and findings (kind, start, end, probability).

    Spans are those of the patterns, which stay whatever the network says, and the candidates outside them that the network finds, as kind
    network; offsets are code points, ends exclusive. probability is the network's for candidates, null for spans of patterns or without a
    detector. Null and empty texts have no spans, and the digest of the empty string; repeated rows are treated alike; an empty table
    gives an empty result. Other columns pass through; columns named as the added ones are replaced.
    """
    added = ("n_assign", "n_access", "n_hex", "n_network", "base_sha256", "spans", "findings")
    names = [c for c in docs.columns if c not in added]
    place = names.index(text_col)
    finding = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            out: list[list] = [[] for _ in added]
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in columns[place].slice(at, 256).to_pylist()]
                base = [base_spans(t) for t in texts]
                open_ = [(i, a, b) for i, t in enumerate(texts) for a, b, known in candidates(t, base[i]) if not known] if detector else []
                p = detector.of_tokens([(texts[i], a, b) for i, a, b in open_]) if detector else []
                more: list[list[dict]] = [[] for _ in texts]
                for (i, a, b), v in zip(open_, p, strict=True):
                    if detector.finds(texts[i][a:b], v):
                        more[i].append({"kind": "network", "start": a, "end": b, "probability": probability(v)})
                for own, extra in zip(base, more, strict=True):
                    every = [{"kind": k, "start": a, "end": b, "probability": None} for k, a, b in own] + extra
                    every.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
                    values = [*(sum(k == kind for k, _, _ in own) for kind in KINDS[:3]), len(extra), hashlib.sha256(joined(own).encode()).hexdigest(), joined([(s["kind"], s["start"], s["end"]) for s in every]), every]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(finding)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*names, *added])

    rows = docs.select(whole(docs, names).alias("_row"))
    schema = "n_assign long, n_access long, n_hex long, n_network long, base_sha256 string, spans string, findings array<struct<kind:string,start:int,end:int,probability:double>>"
    return rows.mapInArrow(run, f"{ddl(docs, names)}, {schema}")


def scan(docs: DataFrame, text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """find_secrets with a detector that learns from all labelled findings of docs itself."""
    return find_secrets(docs, learned(labelled_findings(docs, text_col), recall), text_col)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network")
