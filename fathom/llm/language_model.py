"""Scoring texts by a causal self-attention model over subword ids, trained in numpy, beside a word unigram base.

Masked self-attention over windows of subword ids gives each position a state, which predicts the class of the next id by
a softmax and then the id within its class by the branches of a Huffman tree, each a logistic step of that state. So every
id of the vocabulary has a probability that follows from attention, and they sum to one; ids that no training text has
share a probability of their own. Whether an id begins a new word or is glued to the last is scored too, as are words
that differ from their normal form. Windows overlap; each id is scored once, where it has the longest context.

Words, ids, glued ids and the ids' neighbours are counted over every training text, and make the classes, the trees, the
first values of all biases and the probability of unseen ids. The network's first steps are taken on a sample, where the
driver finds a start; then every id of every training text is predicted in a step: texts are dealt to shards by a hash,
each shard takes steps from that start, and each parameter moves by the shards' mean, weighted by how often they used it.
Counts of the most frequent words go to every worker; others are joined by shuffle, so no table of words is held in one
place.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import crc_remainder, discard, held, least_hashes, slices, stored, table
from fathom.llm.words import LETTERS, MARKS, WordIds

#: Bounds of the sample for the network's first steps: documents by least checksum, a window of LONGEST characters of each.
SAMPLE, LONGEST, STEPS, BATCH = 1500, 8000, 1200, 64
WINDOW, STRIDE, WIDTH, CLASSES, INPUTS = 32, 28, 32, 64, 2048
#: Ids of a shard, of which POOL (whole windows) are mixed at a time; rows of a parameter that are averaged together.
SHARD, POOL, ROWS = 3_000_000, 12_500 * WINDOW, 16
#: Words whose counts are broadcast, 16 bytes each, at most.
FREQUENT = 800_000
#: Windows scored at once.
AT_ONCE = 48
#: Words a worker keeps.
CACHED = 250_000
_MARKS = MARKS.encode()
COMMON = 200
#: What a row of counts is of.
WORD, ID, GLUED, BEGUN = range(4)
LN10 = math.log(10)
_SPACE = re.compile(r"\s")


def lowered(text: str | None) -> list[bytes]:
    """The words: bytes.lower and bytes.split know ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Vocabulary:
    """Subword ids of words, where pieces begin, and what a word costs beside its ids."""

    def __init__(self, tokenizer_json: str) -> None:
        self.words, self.pieces = WordIds(tokenizer_json), {}
        spec = json.loads(tokenizer_json)["model"]["vocab"]
        self.size = max(spec.values()) + 1
        self.size = max(self.size, 49_408)
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in spec.items() if t.endswith("</w>")]] = True
        self.end = self.size - 1

    def ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in self.raw([w.encode("utf-8", "surrogatepass") for w in words])]

    def raw(self, words: list[bytes]) -> list[bytes]:
        """The words' ids as little-endian strings; the caller keeps what it needs."""
        out, odd, pieces, piece = [], [], self.pieces, self.words.piece
        if len(pieces) > CACHED:
            pieces.clear()
        for w in words:
            letters = w.rstrip(_MARKS)
            if (a := pieces.get(letters)) is None:
                plain = letters if letters.isalpha() else self.folded(letters)
                if piece is None or plain is None:
                    odd.append(len(out))
                    out.append(b"")
                    continue
                a = pieces[letters] = piece(plain)
            if len(letters) < len(w):
                marks = w[len(letters) :]
                if (b := pieces.get(marks)) is None:
                    b = pieces[marks] = piece(marks)
                a += b
            out.append(a)
        if odd:
            spelt = [words[i].decode("utf-8", "surrogatepass") for i in odd]
            self.words.learn(set(spelt))
            for i, w in zip(odd, spelt, strict=True):
                out[i] = self.words.known[w]
            self.words.known, self.words.pieces = {"": b""}, {"": b""}
        return out

    @staticmethod
    def folded(letters: bytes) -> bytes | None:
        """Latin letters with accents in lower case; None for anything else."""
        text = letters.decode("utf-8", "surrogatepass")
        return text.lower().encode() if LETTERS.fullmatch(text) else None

    def later(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which ids of words, that lie one after another and begin at ``start``, begin a piece glued to the last."""
        later = np.r_[False, self.closes[flat[:-1]]] if len(flat) else np.zeros(0, bool)
        later[start] = False
        return later


PLAIN_COST, ODD_COST = math.log(0.99), math.log(0.01)


def irregular(word: bytes) -> float:
    """Natural log cost of a word that its ids alone don't determine: of its 2 ** length spellings at most, 1 in 100.
    ASCII words are in lower case already."""
    if word.isascii():
        return PLAIN_COST
    text = word.decode("utf-8", "surrogatepass")
    plain = text == text.lower() and unicodedata.is_normalized("NFC", text) and not _SPACE.search(text)
    return PLAIN_COST if plain else ODD_COST - (len(text) + 1) * math.log(2)


def clustered(bigrams: np.ndarray, counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Clusters of the rows by their neighbours, by k-means on root frequencies."""
    r = np.random.default_rng(seed)
    x = np.sqrt(bigrams / np.maximum(bigrams.sum(1, keepdims=True), 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[r.choice(len(x), min(k, len(x)), replace=False, p=counts / counts.sum())]
    for _ in range(12):
        own = (x @ centre.T).argmax(1)
        for j in range(len(centre)):
            if (own == j).any():
                centre[j] = np.average(x[own == j], axis=0, weights=counts[own == j])
                centre[j] /= max(np.linalg.norm(centre[j]), 1e-9)
    return (x @ centre.T).argmax(1)


class Tally:
    """How often each id occurred in words, began a piece at all, and began one glued to the last."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ids, self.begun, self.glued = (np.zeros(vocabulary.size) for _ in range(3))

    def add(self, words: list[bytes], times: np.ndarray) -> list[bytes]:
        """Count the words, each so many times; gives their ids."""
        raw = self.v.raw(words)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, some = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), size > 0
        start, each = (np.cumsum(size) - size)[some], np.repeat(times, size)
        later, n = self.v.later(flat, start), self.v.size
        self.ids += np.bincount(flat, each, n)
        glued = np.bincount(flat[later], each[later], n)
        self.glued += glued
        self.begun += glued + np.bincount(flat[start], times[some], n)
        return raw


def streamed(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Tally]:
    """The ids of all texts, each between two ends, how many each has, and a tally of their words."""
    lists, tally = [lowered(t) for t in texts], Tally(vocabulary)
    words = Counter(chain.from_iterable(lists))
    ids = dict(zip(words, tally.add(list(words), np.array(list(words.values()), float)), strict=True))
    raw = [b"".join(map(ids.__getitem__, x)) for x in lists]
    tokens = np.array([len(x) // 4 for x in raw], np.int64)
    return between_ends(np.frombuffer(b"".join(raw), "<u4").astype(np.int64), tokens, vocabulary.end), tokens + 2, tally


def neighbours(stream: np.ndarray, sizes: np.ndarray, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id stood after and before each of the common ids, or another one: keys id * (2 * common + 2) +
    place, and counts of those there are."""
    n, place = len(common), np.full(size, len(common))
    place[common] = np.arange(n)
    inner = np.ones(max(len(stream) - 1, 0), bool)
    inner[np.cumsum(sizes)[:-1] - 1] = False
    before, now = stream[:-1][inner], stream[1:][inner]
    return np.unique(np.r_[now * (2 * n + 2) + place[before], before * (2 * n + 2) + n + 1 + place[now]], return_counts=True)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    keys, own = np.unique(keys, return_inverse=True)
    return keys, np.bincount(own, counts, len(keys)).astype(np.int64)


class Trees(NamedTuple):
    """Huffman trees, one for each class. The branches that lead to id i are at start[i] : start[i] + depth[i] of ``node``
    and ``sign``; ``bias`` is each node's log odds by the counts."""

    start: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    sign: np.ndarray
    bias: np.ndarray


def trees(counts: np.ndarray, cls: np.ndarray) -> Trees:
    """Trees of the ids that have a count, by class; ties by id."""
    path: list[list[tuple[int, float]]] = [[] for _ in counts]
    bias: list[float] = []
    members: dict[int, list[int]] = {}
    for i in np.flatnonzero(counts > 0).tolist():
        members.setdefault(int(cls[i]), []).append(i)
    for _, own in sorted(members.items()):
        heap: list = [(float(counts[i]), i, i) for i in own]
        heapq.heapify(heap)
        children, number = [], len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children.append((a, b))
            heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
            number += 1
        stack: list = [(heap[0], [])]
        while stack:
            (_, _, what), way = stack.pop()
            if isinstance(what, tuple):
                at = len(bias)
                bias.append(math.log(what[1][0] / what[0][0]))
                stack.append((what[0], [*way, (at, -1.0)]))
                stack.append((what[1], [*way, (at, 1.0)]))
            else:
                path[what] = way
    depth = np.array([len(x) for x in path], np.int64)
    flat = [y for x in path for y in x]
    node, sign = np.array([n for n, _ in flat], np.int32), np.array([g for _, g in flat], np.float32)
    return Trees(np.cumsum(depth) - depth, depth, node, sign, np.array(bias or [0.0], np.float32))


def columns(df: DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(c.to_numpy() for c in df.toArrow().columns)


def least_count(rows: DataFrame, most: int) -> int:
    """The least count above one that no more than ``most`` rows reach, by a table of counts; nothing is sorted or cut."""
    order = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.where("c > 1").groupBy("c").agg(F.count("*").alias("rows")).withColumn("upto", F.sum("rows").over(order))
    return reached.where(F.col("upto") <= most).agg(F.min("c")).head()[0] or (1 << 62)


def train(
    given: list[str], tokenizer_json: str, seed: int = 5, counts: np.ndarray | None = None,
    glue: tuple[np.ndarray, np.ndarray] | None = None, steps: int = STEPS, near: tuple[np.ndarray, np.ndarray] | None = None,
) -> dict:
    """The model as plain arrays: trees and biases from ``counts`` of ids and ``glue``, classes from ``near`` (of the given
    texts, where there are none), steps on the given texts. Without texts every id is as likely as another."""
    v, rng = Vocabulary(tokenizer_json), np.random.default_rng(seed)
    stream, sizes, own = streamed(v, given)
    counts = (own.ids + np.where(np.arange(v.size) == v.end, len(given), 0) if counts is None else counts).astype(float)
    # glued ids against all of them, by the id
    glued, begun = glue or (own.glued, own.begun)
    glued, begun = glued + 0.5, begun + 1.0
    # ids that no text has share what ids seen once have
    unseen = float((1 + (counts == 1).sum()) / (counts.sum() + 2)) if (counts == 0).any() else 0.0
    absent = math.log(unseen / (counts == 0).sum()) if unseen else 0.0
    # classes: the commonest ids alone, others by their neighbours
    order = np.argsort(-counts, kind="stable")
    alone, seen = CLASSES // 2, int((counts > 0).sum())
    cls = np.full(v.size, CLASSES - 1, np.int64)
    cls[order[:alone]] = np.arange(alone)
    tail = order[alone:seen]
    if len(tail):
        keys, times = near or neighbours(stream, sizes, order[:COMMON], v.size)
        row, wide = np.full(v.size, -1), 2 * len(order[:COMMON]) + 2
        row[tail] = np.arange(len(tail))
        some, beside = row[keys // wide] >= 0, np.zeros((len(tail), wide), np.float32)
        beside[row[keys[some] // wide], keys[some] % wide] = times[some]
        cls[tail] = alone + clustered(beside, counts[tail], CLASSES - alone, seed)
        del beside
    tree = trees(counts, cls)
    inputs = INPUTS + cls
    inputs[order[:INPUTS]] = np.arange(INPUTS)
    w = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
    p = {
        "E": w(INPUTS + CLASSES, WIDTH) * 5, "P": w(WINDOW, WIDTH) * 0.3, "A": w(WIDTH, 3 * WIDTH), "O": w(WIDTH, CLASSES + WIDTH),
        "R": w(WIDTH, CLASSES + WIDTH), "b": np.log(np.bincount(cls, counts, CLASSES) + 1).astype(np.float32), "N": np.zeros((len(tree.bias), WIDTH), np.float32), "n": tree.bias.copy(),
    }
    p["b"] -= p["b"].mean()
    model = {
        "p": p, "cls": cls.astype(np.int32), "inputs": inputs.astype(np.int32), "tree": tree, "has": counts > 0, "absent": absent, "present": math.log1p(-unseen),
        "glue": np.log(glued / (begun + 1)).astype(np.float32), "begin": np.log1p(-glued / (begun + 1)).astype(np.float32),
    }
    docs = np.split(np.arange(len(stream)), np.cumsum(sizes)[:-1])
    starts = np.array([a for d in docs for a in range(int(d[0]), int(d[-1]) + 1 - WINDOW, WINDOW // 2)] if len(stream) else [], np.int64)
    state: dict = {}
    steps = steps if len(starts) > 64 else min(steps, 30)
    for step in range(steps if len(starts) else 0):
        some = stream[rng.choice(starts, BATCH)[:, None] + np.arange(WINDOW + 1)]
        learn(p, model, some, state, 0.02 * (1 - step / steps) + 0.001)
    return model


_CAUSAL = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, calm: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Masked weights and what they gather; queries are scaled. ``calm``: no product is so large that its exponential
    overflows."""
    s = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))  # products with a copy are faster
    s += _CAUSAL
    if not calm:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= (s @ np.ones(s.shape[-1], s.dtype))[..., None]
    return s, np.matmul(s, v)


def softened(x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Softmax of the last axis in place, of what is ``seen``; what is far below the highest of all counts as e ** -80 of it."""
    x = powers(x)
    if seen is not None:
        x *= seen
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def powers(x: np.ndarray) -> np.ndarray:
    """Exponentials in place, all divided by one number where some are large or small."""
    low, high = x.min(), x.max()
    if not -40 < low <= high < 40:
        x -= high
        np.maximum(x, -80, out=x)
    return np.exp(x, out=x)


def runs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``; two numbers are added as one complex one, which is faster."""
    if not len(first):
        return x[:0]
    return np.add.reduceat(x.view(np.result_type(x, np.complex64)), first, axis=0).view(x.dtype)


def grouped(by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal numbers together, the numbers there are, where each one's run begins, and how many they are."""
    order = np.argsort(by.astype(np.uint16) if len(by) and by.max() < 1 << 16 else by, kind="stable")  # short ones by radix
    keys = by.take(order)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    ends = np.full(len(first), len(keys))
    ends[:-1] = first[1:]
    return order, keys.take(first), first, ends - first


def by_level(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Branches in order of their level. Positions come by falling depth, so that each level's branches belong to the first
    of them: the positions that have branches; of each branch the place of its position there, and its level; and from
    where to where each level's branches lie, and how many they are."""
    left = np.cumsum(np.bincount(depth)[:0:-1])[::-1]
    deep = np.argsort((len(left) - depth).astype(np.uint16), kind="stable")[: left[0] if len(left) else 0]
    of, level = spread(np.zeros(len(left), np.int64), left), np.repeat(np.arange(len(left)), left)
    return deep, of, level, [(end - m, end, m) for end, m in zip(np.cumsum(left).tolist(), left.tolist(), strict=True)]


def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, by pieces of rows that stay in a cache."""
    k = 4 * WINDOW if len(x) % (4 * WINDOW) == 0 else WINDOW
    return np.matmul(x.reshape(-1, k, x.shape[1]).transpose(0, 2, 1), y.reshape(-1, k, y.shape[1])).sum(0)


_SEEN = np.tri(WINDOW, dtype=np.float32)


def gradients(p: dict, model: dict, some: np.ndarray, real: np.ndarray | None = None) -> tuple[dict, float, int]:
    """Of the mean loss of an id, for (n, WINDOW + 1) ids: by parameter its rows (None: all), their gradients and how often
    each was used; the loss; and the number of ids. Ids without a count, or that are not ``real``, are not predicted."""
    n, tree, kind, qkv_size = len(some), model["tree"], p["E"].dtype.type, 3 * WIDTH
    given, target = model["inputs"].take(some[:, :-1]).ravel(), some[:, 1:].ravel()
    has, beyond = model["has"].take(target), 0
    if real is not None:  # what lies past a stream's end has no gradient; any input will do
        real = real.ravel()
        has &= real
        beyond, stand_in = len(real) - int(real.sum()), given[real.argmax()]
        given = np.where(real, given, stand_in)
    total, scale = max(1, int(has.sum())), np.where(np.arange(qkv_size) < WIDTH, WIDTH**-0.5, 1).astype(kind)  # of the queries
    weight = has.astype(kind) / kind(total)
    # products with the inputs are made once for each input there is
    order, rows, first, times = grouped(given)
    which = np.empty(len(given), np.int64)
    which[order] = np.repeat(np.arange(len(rows)), times)
    if beyond:
        times[np.searchsorted(rows, stand_in)] -= beyond
    e, into = p["E"].take(rows, 0), p["A"] * scale
    qkv = (e @ into).take(which, 0).reshape(n, -1, qkv_size)
    qkv += p["P"] @ into
    q, k, v = (qkv[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    s = softened(np.matmul(q, k.transpose(0, 2, 1)), _SEEN)
    a = np.matmul(s, v).reshape(-1, WIDTH)
    direct = e @ p["R"]
    y, t = (direct[:, :CLASSES] + p["b"]).take(which, 0), direct[:, CLASSES:].take(which, 0)
    y += a @ p["O"][:, :CLASSES]
    t += a @ p["O"][:, CLASSES:]
    # classes, then branches; gradients of queries, keys, values, classes and states stand side by side
    d = np.empty((len(given), qkv_size + CLASSES + WIDTH), kind)
    dy, dt, dz = d[:, qkv_size : qkv_size + CLASSES], d[:, qkv_size + CLASSES :], d[:, qkv_size:]
    y = powers(y)
    part, own, cls = 1 / (y @ np.ones(CLASSES, kind)), np.arange(len(target)), model["cls"].take(target)
    loss = -(np.log(y.ravel().take(own * CLASSES + cls) * part + 1e-12) * has).sum()
    y *= (part * weight)[:, None]
    y.reshape(-1)[own * CLASSES + cls] -= weight
    dy[:] = y
    deep, of, level, levels = by_level(np.where(has, tree.depth.take(target), 0))
    way = tree.start.take(target.take(deep)).take(of) + level
    node, sign = tree.node.take(way), tree.sign.take(way)
    states, branches = t.take(deep, 0), p["N"].take(node, 0)
    odds = np.empty(len(way), kind)
    for low, high, m in levels:
        np.vecdot(states[:m], branches[low:high], out=odds[low:high])
    odds += p["n"].take(node)
    odds *= sign
    miss = 1 / (1 + np.exp(np.clip(odds, -60, 60)))
    loss -= np.log(1 - miss + 1e-12).sum()
    step = (-sign * miss / total).astype(kind)
    branches *= step[:, None]
    for low, high, m in levels[1:]:
        branches[:m] += branches[low:high]
    dt[:] = 0
    dt[deep] = branches[: len(deep)]
    # back through attention
    da = dz @ p["O"].T
    ds = np.matmul(da.reshape(n, -1, WIDTH), v.transpose(0, 2, 1))
    ds -= np.vecdot(da, a).reshape(n, -1, 1)
    ds *= s
    windowed = d.reshape(n, -1, d.shape[1])
    np.matmul(ds, k, out=windowed[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=windowed[..., WIDTH : 2 * WIDTH])
    np.matmul(s.transpose(0, 2, 1), da.reshape(n, -1, WIDTH), out=windowed[..., 2 * WIDTH : qkv_size])
    dx = d @ np.concatenate((into, p["R"]), 1).T
    placed, both = windowed[..., :qkv_size].sum(0), crossed(e.take(which, 0), d)
    di = (both[:, :qkv_size] + p["P"].T @ placed) * scale
    in_order, nodes, begin, met = grouped(node)
    states = states.take(of.take(in_order), 0)
    states *= (step := step.take(in_order))[:, None]
    g = {"E": (rows, runs(dx.take(order, 0), first), times), "N": (nodes, runs(states, begin), met), "n": (nodes, np.add.reduceat(step, begin) if len(begin) else step, met)}
    g |= {w: (None, x, total) for w, x in (("P", placed @ into.T), ("A", di), ("O", crossed(a, dz)), ("R", both[:, qkv_size:]), ("b", np.ones(len(d), kind) @ dy))}
    return g, float(loss / total), total


#: Parameters whose moments lie one after another, so that a step on all of them is one: whole ones, and rows of them.
_WHOLE, _ROWS = ("P", "A", "O", "R", "b"), ("E", "N")


def moments(p: dict) -> dict:
    """Adam's state before the first step: by parameter both of its moments, which are parts of common arrays."""
    state: dict = {"t": 0, "n": [np.zeros_like(p["n"]) for _ in range(2)]}
    for key, names, flat in (("whole", _WHOLE, True), ("rows", _ROWS, False)):
        sizes = [p[w].size if flat else len(p[w]) for w in names]
        state[key] = [np.zeros(sum(sizes) if flat else (sum(sizes), WIDTH), p["E"].dtype) for _ in range(2)]
        for w, end, size in zip(names, np.cumsum(sizes).tolist(), sizes, strict=True):
            state[w] = [x[end - size : end].reshape(p[w].shape) for x in state[key]]
    return state


def learn(p: dict, model: dict, some: np.ndarray, state: dict, rate: float, real: np.ndarray | None = None, used: dict | None = None) -> float:
    """One Adam step on (n, WINDOW + 1) ids, of the rows they use; gives the mean loss of an id. ``used`` adds up how often
    each row was."""
    g, loss, _ = gradients(p, model, some, real)
    if not state:
        state |= moments(p)
    state["t"] = t = state["t"] + 1

    def move(key: str, at: np.ndarray | None, d: np.ndarray) -> np.ndarray:
        m, u = state[key]
        first, second = (m, u) if at is None else (m.take(at, 0), u.take(at, 0))
        first, second = first + 0.1 * (d - first), second + 0.01 * (d * d - second)
        at = slice(None) if at is None else at
        m[at], u[at] = first, second
        second *= 1 / (1 - 0.99**t)
        np.sqrt(second, out=second)
        second += 1e-8
        first *= rate / (1 - 0.9**t)
        first /= second
        return first

    (rows, de, _), (nodes, dn, _) = g["E"], g["N"]
    moves = move("rows", np.r_[rows, len(p["E"]) + nodes], np.concatenate((de, dn)))
    p["E"][rows] -= moves[: len(rows)]
    p["N"][nodes] -= moves[len(rows) :]
    p["n"][nodes] -= 0.1 * move("n", nodes, g["n"][1])  # biases begin at the counts of all texts
    moves, at = move("whole", None, np.concatenate([g[w][1].ravel() for w in _WHOLE])), 0
    for w in _WHOLE:
        p[w] -= moves[at : at + p[w].size].reshape(p[w].shape) * (0.1 if w == "b" else 1)
        at += p[w].size
    if used is not None:
        for name, (at, _, times) in g.items():
            if name not in used:
                used[name] = np.zeros(len(p[name]))
            used[name][slice(None) if at is None else at] += times
    return loss


def windows(stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW + 1) ids, and whether each that a window predicts is there: each id but a stream's first is predicted
    once."""
    number = -(-(sizes - 1) // WINDOW)
    place = (np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)) * WINDOW
    first, left = np.repeat(np.cumsum(sizes) - sizes, number) + place, np.repeat(sizes, number) - place
    some = np.r_[stream, np.zeros(WINDOW, stream.dtype)][first[:, None] + np.arange(WINDOW + 1)]
    return some, np.arange(1, WINDOW + 1) < left[:, None]


class Pupil:
    """A shard's steps from the model's start, over all of its streams of ids."""

    def __init__(self, model: dict, shard: int, expected: float) -> None:
        self.m, self.p = model, {k: v.copy() for k, v in model["p"].items()}
        self.rng, self.expected, self.done = np.random.default_rng(shard), expected, 0
        self.state, self.used = {}, {}  # type: dict, dict

    def take(self, stream: np.ndarray, sizes: np.ndarray) -> None:
        """Steps over all windows of the streams, in mixed order."""
        some, real = windows(stream, sizes)
        order = self.rng.permutation(len(some))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            learn(self.p, self.m, some[own], self.state, 0.01 * max(0.0, 1 - self.done / self.expected) + 0.0005, real[own], self.used)
            self.done += int(real[own].sum())

    def moved(self) -> Iterator[tuple[str, int, bytes, bytes]]:
        """(parameter, first row, uses, moves) of ROWS rows each, where they were used."""
        for name, used in self.used.items():
            moves = (self.p[name] - self.m["p"][name]).reshape(len(used), -1)
            for a in range(0, len(used), ROWS):
                if used[a : a + ROWS].any():
                    yield name, a, used[a : a + ROWS].tobytes(), moves[a : a + ROWS].astype("<f4").tobytes()


class Numbered(dict):
    """Numbers of words; a word it doesn't have gets the next one and waits in ``new``."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Scorer:
    """A worker's model; keeps what it has found out about words."""

    def __init__(self, model: dict, tokenizer_json: str, frequent: tuple[np.ndarray, np.ndarray]) -> None:
        """``frequent``: sorted unsigned hashes of the frequent words, and log10(c + 1) of each."""
        self.m, self.v, self.frequent = model, Vocabulary(tokenizer_json), frequent
        p = model["p"]
        scale = np.where(np.arange(3 * WIDTH) < WIDTH, WIDTH**-0.5, 1).astype(np.float32)  # of the queries
        self.qkv, self.place = p["E"] @ p["A"] * scale, p["P"] @ p["A"] * scale
        # bounds of all products there can be: where they are small, exponentials need no maximum taken off first
        far = lambda x: float(np.linalg.norm(x, axis=1).max())
        q, k, v = ((self.qkv[:, i * WIDTH : (i + 1) * WIDTH], self.place[:, i * WIDTH : (i + 1) * WIDTH]) for i in range(3))
        self.calm = (far(q[0]) + far(q[1])) * (far(k[0]) + far(k[1])) < 80
        split = lambda x: (np.ascontiguousarray(x[:, :CLASSES]), np.ascontiguousarray(x[:, CLASSES:]))
        self.head, self.state = zip(split(p["E"] @ p["R"]), split(p["O"]), strict=True)
        self.head[0][:] += p["b"]
        self.calm_head = sum(float(np.abs(x).max()) for x in (self.head[0], v[0] @ self.head[1], v[1] @ self.head[1])) < 80
        t = model["tree"]
        # each id's branches with their signs in the weights, so that every step is a logistic of one product
        self.branch, self.odds = p["N"][t.node] * t.sign[:, None], p["n"][t.node] * t.sign
        self.forget()

    def forget(self) -> None:
        self.number, self.seen = Numbered(), np.zeros(0, np.int64)
        self.cost, self.count, self.hash = (np.zeros(0, t) for t in (np.float64, np.float64, np.int64))
        # a word's ids are flat[start : start + size]
        self.flat, self.start, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, lists: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words, of which new ones are found out about. When there are too many, only those that have
        occurred more than once are kept."""
        if len(self.number) > CACHED:
            keep = np.flatnonzero(self.seen > 1)
            words = list(self.number)
            self.number = Numbered()
            self.number.update((words[i], n) for n, i in enumerate(keep.tolist()))
            self.flat = self.flat[spread(self.start[keep], self.size[keep])]
            self.cost, self.count, self.hash, self.size, self.seen = self.cost[keep], self.count[keep], self.hash[keep], self.size[keep], self.seen[keep] // 2
            self.start = np.cumsum(self.size) - self.size
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if self.number.new:
            self.meet(self.number.new)
            self.number.new = []
        self.seen = np.bincount(at, minlength=len(self.number)) + np.pad(self.seen, (0, len(self.number) - len(self.seen)))
        return at

    def meet(self, new: list[bytes]) -> None:
        raw = self.v.raw(new)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        keys, logs = self.frequent
        place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        count = np.where(keys[place] == hashes, logs[place], -1.0) if len(keys) else np.full(len(new), -1.0)
        cost = np.full(len(new), PLAIN_COST)
        for i in [i for i, w in enumerate(new) if not w.isascii()]:
            cost[i] = irregular(new[i])
        sizes = np.fromiter(map(len, raw), np.int64, len(new)) // 4
        flat, start = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.cumsum(sizes) - sizes
        has = np.flatnonzero(sizes)
        cost[sizes == 0] += math.log(1e-6)
        if len(has):
            first = start[has]
            later = self.v.later(flat, first)  # what follows a piece's end in one word is glued to it
            cost[has] += self.m["begin"][flat[first]] + np.add.reduceat(np.where(later, self.m["glue"][flat], 0), first)
        own = ((self.cost, cost), (self.count, count), (self.hash, hashes.view(np.int64)), (self.start, start + len(self.flat)), (self.size, sizes), (self.flat, flat))
        self.cost, self.count, self.hash, self.start, self.size, self.flat = map(np.concatenate, own)

    def score(self, given: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Of each text: words, sum of log10(c + 1) and number of frequent ones, hashes of others, log10 probability."""
        lists = [lowered(t) for t in given]
        words, n = np.fromiter(map(len, lists), np.int64, len(lists)), len(lists)
        at = self.numbers(lists)
        owner, counts, sizes = np.repeat(np.arange(n), words), self.count[at], self.size[at]
        common = counts >= 0
        known = np.bincount(owner[common], minlength=n)
        sums, cost = np.bincount(owner[common], counts[common], n), np.bincount(owner, self.cost[at], n)
        tokens = np.bincount(owner, sizes, n).astype(np.int64)
        stream = between_ends(self.flat[spread(self.start[at], sizes)], tokens, self.v.end)
        found = self.log_probabilities(stream, tokens + 2)
        rare = np.split(self.hash[at[~common]], np.cumsum(words - known)[:-1]) if n else []
        return words, sums, known, rare, (cost + found) / LN10

    def log_probabilities(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The natural log probability of each stream of ids, which lie one after another in ``flat``."""
        begin, n = np.cumsum(sizes) - sizes, len(sizes)
        m, tree = self.m, self.m["tree"]
        owner = np.repeat(np.arange(n), sizes)
        # every id but a stream's first is scored by the first window that holds the one before it
        ahead = np.ones(len(flat), bool)
        ahead[begin + sizes - 1] = False
        at = np.flatnonzero(ahead)
        given, to, cls, place = m["inputs"][flat], flat[at + 1], m["cls"][flat[at + 1]], at - begin[owner[at]]
        number = np.maximum(0, -(-(place + 1 - WINDOW) // STRIDE))
        windows = np.maximum(1, -(-(sizes - 1 - WINDOW + STRIDE) // STRIDE))
        earlier, before = np.cumsum(windows) - windows, given[at]
        row, column = earlier[owner[at]] + number, place - number * STRIDE
        first = np.repeat(begin - earlier * STRIDE, windows) + np.arange(int(windows.sum())) * STRIDE
        padded, found, ones = np.r_[given, np.zeros(WINDOW, np.int32)], np.zeros(len(at)), np.ones(CLASSES, np.float32)
        bounds = np.searchsorted(row, np.arange(0, len(first) + AT_ONCE, AT_ONCE))
        for a, low, high in zip(range(0, len(first), AT_ONCE), bounds[:-1], bounds[1:], strict=True):
            # what lies past a stream's end is seen by no position before it
            x = self.qkv.take(padded[first[a : a + AT_ONCE, None] + np.arange(WINDOW)], 0)
            x += self.place
            _, out = attention(x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :], self.calm)
            out = out.reshape(-1, WIDTH).take((row[low:high] - a) * WINDOW + column[low:high], 0)
            head, state = out @ self.head[1], out @ self.state[1]
            head += self.head[0].take(before[low:high], 0)
            state += self.state[0].take(before[low:high], 0)
            if not self.calm_head:
                head -= head.max(1, keepdims=True)
            own = head[np.arange(high - low), cls[low:high]] - np.log(np.exp(head, out=head) @ ones)
            depth, start = tree.depth[to[low:high]], tree.start[to[low:high]]
            way, of = spread(start, depth), np.repeat(np.arange(high - low), depth)
            odds = np.einsum("nd,nd->n", state.take(of, 0), self.branch.take(way, 0)) + self.odds.take(way)
            found[low:high] = own - np.bincount(of, np.log1p(np.exp(np.minimum(-odds, 80))), high - low)
        found = np.where(m["has"][to], found + m["present"], m["absent"])
        return np.bincount(owner[at], found, n)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run of ``size``, one run after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def between_ends(ids: np.ndarray, tokens: np.ndarray, end: int) -> np.ndarray:
    """The ids of texts, ``tokens`` of each, with an end before and after each text's."""
    out = np.full(len(ids) + 2 * len(tokens), end, np.int64)
    out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(tokens)) + 1, tokens)] = ids
    return out


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) of every word; a worker adds up what it meets before it is shuffled."""

    def told(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                for text in part.column(text_col).to_pylist():
                    words.update(lowered(text))
                if len(words) > CACHED:
                    yield told(words)
                    words = Counter()
        yield told(words)

    return docs.select(text_col).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def tallied(words: DataFrame, tokens: str) -> DataFrame:
    """(kind, h, c): counts of words by their 64-bit hashes; and of ids, glued ids and ids that begin a piece, by task."""
    sent = words.sparkSession.sparkContext.broadcast(tokens)

    def told(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(held(("vocabulary", hash(sent.value)), lambda: Vocabulary(sent.value)))
        for batch in batches:
            some, times = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            tally.add(some, times.astype(float))
            yield told(WORD, np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some)).view(np.int64), times)
        for kind, counts in ((ID, tally.ids), (GLUED, tally.glued), (BEGUN, tally.begun)):
            keys = np.flatnonzero(counts)
            yield told(kind, keys, counts[keys].astype(np.int64))

    return words.mapInArrow(run, "kind tinyint, h bigint, c bigint")


def width(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def encoded(docs: DataFrame, order: Column, text_col: str, tokens: str) -> DataFrame:
    """(o, ids) of every text: its ``order``, and all of its ids as little-endian numbers as long as the last id needs."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = held(("vocabulary", hash(sent.value)), lambda: Vocabulary(sent.value)), {}
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                lists = [lowered(t) for t in part.column("text").to_pylist()]
                if len(known) > CACHED:
                    known = {}
                new = list(set().union(*lists) - known.keys())
                known.update(zip(new, v.raw(new), strict=True))
                ids = [np.frombuffer(b"".join(map(known.__getitem__, x)), "<u4").astype(width(v.end)).tobytes() for x in lists]
                yield pa.RecordBatch.from_arrays([part.column("o"), pa.array(ids, pa.binary())], names=["o", "ids"])

    return docs.select(order.alias("o"), F.col(text_col).alias("text")).mapInArrow(run, "o bigint, ids binary")


def pooled(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of rows of ``encoded``, each text's between two ends, and their numbers; about POOL ids at a time. Of a longer
    text come pieces: whole windows, and the id after them, with which the next piece begins."""
    kind = np.dtype(width(end))

    def flat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
        return between_ends(np.frombuffer(b"".join(raw), kind).astype(np.int64), tokens, end), tokens + 2

    waiting: list[bytes] = []
    size = 0
    for batch in batches:
        for ids in batch.column("ids"):
            raw = ids.as_py()
            if len(raw) // kind.itemsize >= POOL:
                stream, _ = flat([raw])
                for a in range(0, len(stream) - 1, POOL):
                    piece = stream[a : a + POOL + 1]
                    yield piece, np.array([len(piece)])
                continue
            waiting.append(raw)
            size += len(raw) // kind.itemsize + 2
            if size >= POOL:
                yield flat(waiting)
                waiting, size = [], 0
    if waiting:
        yield flat(waiting)


def all_neighbours(streams: DataFrame, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``neighbours`` of all streams."""
    sent = streams.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), 1_000_000
        for stream, sizes in pooled(batches, size - 1):
            more, times = neighbours(stream, sizes, sent.value, size)
            keys, counts = added(np.r_[keys, more], np.r_[counts, times])
            if len(keys) > kept:
                yield told(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield told(keys, counts)

    def told(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["h", "c"])

    found = streams.select("ids").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    return columns(found)


MOVED = "name string, first int, shard int, used binary, moves binary"


def shards(streams: DataFrame, model: dict, n: float, end: int) -> DataFrame:
    """What each shard's steps over all of its streams move, by parts of parameters; ``n``: ids of all streams to predict.
    Shards and their order depend on the rows alone, not on how the table is stored."""
    number = max(1, -(-int(n) // SHARD))
    sent = streams.sparkSession.sparkContext.broadcast(pickle.dumps(model, 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        pupil = Pupil(held(("start", hash(sent.value)), lambda: pickle.loads(sent.value)), shard, n / number)  # noqa: S301
        for stream, sizes in pooled(batches, end):
            pupil.take(stream, sizes)
        for name, first, used, moves in pupil.moved():
            yield pa.RecordBatch.from_pylist([{"name": name, "first": first, "shard": shard, "used": used, "moves": moves}], schema=_MOVED)

    return streams.repartition(number, "o").sortWithinPartitions("o", "ids").mapInArrow(run, MOVED)


_MOVED = pa.schema([("name", pa.string()), ("first", pa.int32()), ("shard", pa.int32()), ("used", pa.binary()), ("moves", pa.binary())])


def mean_moves(parts: pa.Table) -> pa.Table:
    """One part of a parameter: its rows' moves, weighted by uses; shards in order, so that sums are the same again."""
    total = moves = 0.0
    for r in sorted(parts.to_pylist(), key=lambda r: r["shard"]):
        used = np.frombuffer(r["used"])
        total, moves = total + used, moves + used[:, None] * np.frombuffer(r["moves"], "<f4").reshape(len(used), -1)
    mean = (moves / np.maximum(total, 1)[:, None]).astype("<f4")
    return pa.table({"name": parts["name"][:1], "first": parts["first"][:1], "moves": pa.array([mean.tobytes()], pa.binary())})


def taught(streams: DataFrame, model: dict, n: float, end: int) -> dict:
    """The model after steps over every id of all streams: each row of a parameter moves by the shards' weighted mean."""
    moved = shards(streams, model, n, end).groupBy("name", "first").applyInArrow(mean_moves, "name string, first int, moves binary")
    p = {k: v.copy() for k, v in model["p"].items()}
    for r in moved.toArrow().to_pylist():
        rows = p[r["name"]].reshape(len(p[r["name"]]), -1)
        moves = np.frombuffer(r["moves"], "<f4").reshape(-1, rows.shape[1])
        rows[r["first"] : r["first"] + len(moves)] += moves
    return model | {"p": p}


def window_of(text: Column, order: Column) -> Column:
    """The text, or LONGEST characters of a longer one from a place chosen by ``order``."""
    return F.substring(text, F.pmod(order, F.greatest(F.length(text) - LONGEST, F.lit(0)) + 1).cast("int") + 1, F.lit(LONGEST))


def scorer(packed: bytes) -> Scorer:
    return held(("language model", hash(packed)), lambda: Scorer(*pickle.loads(packed)))  # noqa: S301


SCORED = "doc_id bigint, text_key bigint, n_words bigint, sum double, known bigint, rare array<bigint>, score double"


def score(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Null text counts as empty: its one token is the end. Each training row's end counts as a word of its own. Without
    training rows nothing is known and the base is log10(1 / (0 + 1)) a token. Repeated rows get equal results; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()  # noqa: SIM115
    every = stored(tallied(counted(training, text_col), tokens))
    counts = every.where(F.col("kind") == WORD).select("h", "c")
    ends = training.count()
    total = counts.agg(F.sum("c"), F.count("*")).head()
    n, v = (total[0] or 0) + ends, total[1] + (ends > 0)
    least = least_count(counts, FREQUENT) if v else 1
    top, times = columns(counts.where(F.col("c") >= least))
    in_order = np.argsort(top.view(np.uint64))
    frequent = top.view(np.uint64)[in_order], np.log10(times[in_order] + 1.0)
    # three rows an id of the vocabulary at most
    kind, h, c = columns(every.where(F.col("kind") > WORD).groupBy("kind", "h").agg(F.sum("c").alias("c")))
    known = Vocabulary(tokens)
    ids, glued, begun = (np.bincount(h[kind == k], c[kind == k], known.size) for k in (ID, GLUED, BEGUN))
    ids[known.end] += ends
    order = F.xxhash64(F.col(id_col).cast("string"))
    some = training.where(least_hashes(order, SAMPLE, ends))
    some = some.select(order.alias("o"), window_of(F.col(text_col), order).alias("text")).orderBy("o", "text").limit(SAMPLE)
    streams = stored(encoded(training, F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), text_col, tokens))
    near = all_neighbours(streams, np.argsort(-ids, kind="stable")[:COMMON], known.size)
    model = train([r.text for r in some.collect()], tokens, counts=ids, glue=(glued, begun), near=near)
    model = taught(streams, model, ids.sum(), known.end)
    discard(streams)
    del near
    sent = spark.sparkContext.broadcast(pickle.dumps((model, tokens, frequent), 5))
    del model, frequent, top, times, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                given = [x or "" for x in part.column("text").to_pylist()]
                words, sums, known, rare, found = own.score(given)
                keys = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in given], np.uint64).view(np.int64)
                columns = [part.column("doc_id"), pa.array(keys, pa.int64()), pa.array(words, pa.int64()), pa.array(sums, pa.float64()), pa.array(known, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = stored(given.mapInArrow(run, SCORED))
    # words that are not among the frequent ones: each has less than their least count
    others = scored.select("text_key", F.explode("rare").alias("h"))
    zero = F.lit(0.0)
    words = counts.where(F.col("c") < least).select("h", F.log10(F.col("c") + 1).alias("base"))
    joined = others.join(words, "h").groupBy("text_key").agg(F.sum("base").alias("base"), F.count("*").alias("also"))
    copies = scored.groupBy("text_key").agg(F.count("*").alias("copies"))  # equal texts share a sum
    each = lambda name: (F.col(name) / F.col("copies")).alias(name)
    more = stored(joined.join(copies, "text_key").select("text_key", each("base"), each("also").cast("bigint").alias("also")))
    end = math.log10(ends + 1)
    rows = scored.drop("rare").join(more, "text_key", "left").withColumn("n_tokens", F.col("n_words") + 1)
    base = F.col("sum") + F.coalesce("base", zero) + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    known = F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(ends > 0))
    return rows.select(
        F.col("doc_id").alias(id_col), "n_tokens", known.cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score",
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_remainder(F.col("doc_id"), 7) == 2
    out = score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
