"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word comes in as characters and as itself: its character n-grams and its form look up how much more often than
chance they stand in texts marked toxic (a signed root of the likelihood ratio, cross-fitted so that no text is judged
by counts from itself), next to embeddings that are trained with the network. Overlapping windows cover the whole text;
the text's score is its highest window's, calibrated on held-back training rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import crc_remainder, given_back, held, slices, table, texts

#: Bounds of the labelled sample: rows of each label, by least checksum of their ids, none longer than LONGEST.
TOXIC, CLEAN, LONGEST = 1000, 2000, 8_000
WINDOW, STRIDE = 48, 40
HIDDEN, EMBED, CHARS = 8, 6, 12
BUCKETS, SMALL = 1 << 18, 1 << 12
GRAMS = (3, 4, 5)
SIGNALS = 2 * len(GRAMS) + 1
INPUT = SIGNALS + 2 * EMBED
THRESHOLD = 0.3
#: Characters of a word that are looked up as one; longer words are cut at marks, then into pieces.
LONG, PIECE = 64, 16
#: Words a worker keeps, about 400 bytes each; texts of more words than PART are read in parts of so many.
CACHED, PART = 100_000, 1 << 16
#: Training windows scored at once; each takes about 50 KB.
AT_ONCE = 256
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SPACED = str.maketrans(MARKS, " " * len(MARKS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def clean(word: str) -> str:
    """A word's form; pieces of long words, told by a line feed, are in it already."""
    return word[1:] if word[:1] == "\n" else word.lower().strip(MARKS)


def split(text: str) -> list[str]:
    """The text's words. One whose form has over LONG characters, such as a text without white space, is cut at marks;
    what is longer still, into pieces of PIECE characters, which overlap by the longest n-gram so that none is lost."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG // 2:  # lower case at most doubles a word's length
        return words
    out = []
    for w in words:
        form = clean(w) if len(w) > LONG // 2 else ""
        if len(form) <= LONG:
            out.append(w)
            continue
        for part in form.translate(_SPACED).split():
            size, last = (PIECE, max(1, len(part) - max(GRAMS))) if len(part) > LONG else (LONG, 1)
            out.extend("\n" + part[a : a + size] for a in range(0, last, size - max(GRAMS)))
    return out


def grams(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n of GRAMS, hashes of the words' n-grams (with the word's ends marked) and which word each is of;
    and a hash of each word."""
    raw = [b"\2" + w.encode("utf-8", "replace") + b"\3" for w in words]
    sizes = np.array([len(r) for r in raw])
    data, owner = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    out = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(data) < n:
                out.append((np.zeros(0, np.int32), np.zeros(0, np.int32)))
                continue
            h = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ data[i : len(data) - n + 1 + i]) * _MIX
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            out.append(((h[inside] >> np.uint64(40)).astype(np.int32) % BUCKETS, owner[: len(h)][inside]))
        ends = np.cumsum(sizes)
        place = np.arange(len(data), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes)
        mixed = (data + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * _MIX)
        mixed ^= mixed >> np.uint64(31)
        whole = np.add.reduceat(mixed * _MIX, ends - sizes) if len(raw) else np.zeros(0, np.uint64)
    return out, (whole >> np.uint64(20)).astype(np.int64)


def ratio(toxic: np.ndarray, plain: np.ndarray, n_toxic: int, n_plain: int) -> np.ndarray:
    """Signed root of twice the log likelihood ratio of document counts, about unit size for chance."""
    a, b = toxic.astype(float), plain.astype(float)
    rate = (a + b) / (n_toxic + n_plain)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)
    score = 2 * (part(a, rate * n_toxic) + part(b, rate * n_plain))
    sign = np.where(a * n_plain >= b * n_toxic, 1, -1)
    return (sign * np.sqrt(np.maximum(score, 0)) / 6).clip(-1.5, 3).astype(np.float32)


def signals(tables: list[np.ndarray], found, whole: np.ndarray, n: int) -> np.ndarray:
    """(n, SIGNALS): each n-gram length's strongest and mean ratio in the word, and the word's own."""
    out = np.zeros((n, SIGNALS), np.float32)
    for k, (h, owner) in enumerate(found):
        if len(h):
            values, first = tables[k][h], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            has = owner[first]
            out[has, 2 * k] = np.maximum.reduceat(values, first)
            out[has, 2 * k + 1] = np.add.reduceat(values, first) / np.diff(np.r_[first, len(owner)])
    out[:, -1] = tables[-1][whole % BUCKETS]
    return out


def characters(found, n: int) -> np.ndarray:
    """(n, CHARS) embedding rows of each word's first trigrams, 0 where there are fewer."""
    h, owner = found[0]
    out = np.zeros((n, CHARS), np.int32)
    first = np.searchsorted(owner, np.arange(n, dtype=owner.dtype))
    place = np.arange(len(owner)) - first[owner]
    keep = place < CHARS
    out[owner[keep], place[keep]] = 1 + h[keep] % (SMALL - 1)
    return out


def windows(n: int) -> list[int]:
    """Where windows begin in a text of n words; together they cover it."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The recurrent network; ``p`` holds its parameters."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        w = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {"word": w(SMALL, EMBED) * 2, "char": w(SMALL, EMBED) * 2, "query": w(2 * h, h), "value": w(h, 1)[:, 0], "out": w(2 * h, 1)[:, 0], "bias": np.float32([-1])}
        for d in "fb":
            self.p |= {f"W{d}": w(INPUT, 3 * h), f"U{d}": w(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def inputs(self, sig: np.ndarray, word: np.ndarray, chars: np.ndarray) -> np.ndarray:
        used = chars > 0
        mean = (self.p["char"][chars] * used[..., None]).sum(-2) / np.maximum(used.sum(-1), 1)[..., None]
        return np.concatenate([sig, self.p["word"][word], mean], -1).astype(np.float32)

    def run(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: list | None = None) -> dict[str, np.ndarray]:
        """Hidden states (T, N, H) of each direction; gates are (T, N, 3H), mask is (T, N, 1)."""
        out, steps, n = {}, *gates["f"].shape[:2]
        for d in "fb":
            u, h, all_h = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a, x = h @ u, gates[d][t]
                zr = squash(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = h + mask[t] * z * (c - h)
                if keep is not None:
                    keep.append((d, t, h, a, z, r, c))
                all_h[t] = h = new
            out[d] = all_h
        return out

    def pooled(self, h: np.ndarray, mask: np.ndarray):
        key = np.tanh(h @ self.p["query"])
        score = np.where(mask[..., 0] > 0, key @ self.p["value"], -1e9)
        w = np.exp(score - score.max(0)) * mask[..., 0]
        w /= np.maximum(w.sum(0), 1e-9)
        return key, w, (w[..., None] * h).sum(0)

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        both = self.run(gates, mask)
        _, _, s = self.pooled(np.concatenate([both["f"], both["b"]], -1), mask)
        return s @ self.p["out"] + self.p["bias"][0]

    def learn(self, sig, word, chars, mask, label, state: dict, rate: float) -> float:
        """One Adam step on a batch of windows, (T, N, ...) each; gives the loss."""
        p, x, keep = self.p, self.inputs(sig, word, chars), []
        gates = {d: x @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}
        both = self.run(gates, mask, keep)
        h = np.concatenate([both["f"], both["b"]], -1)
        key, w, s = self.pooled(h, mask)
        y = squash(s @ p["out"] + p["bias"][0])
        loss = -np.mean(np.where(label, np.log(y + 1e-7), np.log(1 - y + 1e-7)))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dy = ((y - label) / len(label)).astype(np.float32)
        g["out"], g["bias"][0] = s.T @ dy, dy.sum()
        ds = dy[:, None] * p["out"]
        dh = w[..., None] * ds
        dw = (h * ds).sum(-1)
        dscore = w * (dw - (w * dw).sum(0))
        g["value"] = np.einsum("tn,tnh->h", dscore, key)
        dkey = dscore[..., None] * p["value"] * (1 - key**2)
        g["query"] = np.einsum("tni,tnj->ij", h, dkey)
        dh += dkey @ p["query"].T
        dgates = {d: np.zeros_like(gates[d]) for d in "fb"}
        carry = {d: np.zeros(both["f"].shape[1:], np.float32) for d in "fb"}
        for d, t, before, a, z, r, c in reversed(keep):
            half = dh[t][:, :HIDDEN] if d == "f" else dh[t][:, HIDDEN:]
            back = carry[d] + half
            new = back * mask[t]
            dz, dc = new * (c - before) * z * (1 - z), new * z * (1 - c**2)
            dr = dc * a[:, 2 * HIDDEN :] * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], 1)
            dgates[d][t] = np.concatenate([dz, dr, dc], 1)
            g[f"U{d}"] += before.T @ da
            carry[d] = back - new * z + da @ p[f"U{d}"].T
        dx = 0
        for d in "fb":
            g[f"W{d}"], g[f"b{d}"] = np.einsum("tni,tnj->ij", x, dgates[d], optimize=True), dgates[d].sum((0, 1))
            dx = dx + dgates[d] @ p[f"W{d}"].T
        np.add.at(g["word"], word, dx[..., SIGNALS : SIGNALS + EMBED])
        used = chars > 0
        per = dx[..., None, SIGNALS + EMBED :] * (used / np.maximum(used.sum(-1, keepdims=True), 1))[..., None]
        np.add.at(g["char"], chars, per.astype(np.float32))
        state["t"] = n = state.get("t", 0) + 1
        for k in p:
            m, v = state.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            own = rate * (0.1 if k in ("word", "char") else 1)  # embeddings of rare words would learn the sample by heart
            p[k] -= (own * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return float(loss)


class Lexicon:
    """Word numbers and what ``grams`` says of them, for the training rows."""

    def __init__(self, given: list[str]) -> None:
        number: dict[str, int] = {"": 0}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in map(clean, split(t))], np.int64) for t in given]
        self.words = list(number)
        self.found, self.whole = grams(self.words)
        self.chars, self.small = characters(self.found, len(self.words)), self.whole % SMALL
        self.spans = [np.searchsorted(o, np.arange(len(self.words) + 1, dtype=o.dtype)) for _, o in self.found]

    def tables(self, which: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        counts = [np.zeros((2, BUCKETS), np.int32) for _ in range(len(GRAMS) + 1)]
        for i in which.tolist():
            own = np.unique(self.docs[i])
            for k, (h, _) in enumerate(self.found):
                a, n = self.spans[k][own], self.spans[k][own + 1] - self.spans[k][own]
                at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                counts[k][int(label[i]), np.unique(h[at])] += 1
            counts[-1][int(label[i]), np.unique(self.whole[own] % BUCKETS)] += 1
        n1 = int(label[which].sum())
        return [ratio(c[1], c[0], n1, len(which) - n1) for c in counts]

    def forget(self) -> None:
        """Give up the words and their n-grams, most of what is held; windows are made of the rest."""
        del self.words, self.found, self.whole, self.spans


def train(given: list[str], label: np.ndarray, seed: int = 7, epochs: int = 4, share: float | None = None) -> dict:
    """The model as plain arrays: tables, parameters, calibration. Without rows of both labels it has ``constant``.

    ``share`` is that of toxic rows among all labelled ones, where the sample has another."""
    label = label.astype(np.float32)
    if not len(label) or label.min() == label.max():
        return {"constant": float(label.mean()) if len(label) else 0.0}
    rng, lex = np.random.default_rng(seed), Lexicon(given)
    fold = np.arange(len(given)) % 2
    halves = [lex.tables(np.flatnonzero(fold == f), label) for f in (0, 1)]
    sig = [signals(t, lex.found, lex.whole, len(lex.words)) for t in halves]
    lex.forget()
    held = rng.random(len(given)) < 0.15  # for the calibration
    places = [(i, a) for i, d in enumerate(lex.docs) for a in windows(len(d))]
    owner, ids = np.array([i for i, _ in places]), np.zeros((len(places), WINDOW), np.int32)
    for k, (i, a) in enumerate(places):
        part = lex.docs[i][a : a + WINDOW]
        ids[k, : len(part)] = part
    few = np.flatnonzero(label == 0)  # a clean text's first words, down to none, are clean too
    stubs = np.zeros((len(few), WINDOW), np.int32)
    for k, i in enumerate(few.tolist()):
        part = lex.docs[i][: k % 6]
        stubs[k, : len(part)] = part
    ids, owner = np.concatenate([ids, stubs]), np.concatenate([owner, few])
    pool = len(ids)
    mask = ids > 0
    strength = np.where(fold[owner, None] == 0, sig[1][:, : 2 * len(GRAMS) : 2].sum(1)[ids], sig[0][:, : 2 * len(GRAMS) : 2].sum(1)[ids]).max(1)
    net, state, rate = Network(seed), {}, 0.01

    def batch(k: np.ndarray):
        i = ids[k].T
        s = np.where((fold[owner[k]] == 0)[None, :, None], sig[1][i], sig[0][i])
        return s, lex.small[i], lex.chars[i], mask[k].T[..., None].astype(np.float32)

    def scored() -> np.ndarray:
        out = np.zeros(pool, np.float32)
        for a in range(0, pool, AT_ONCE):
            s, w, c, m = batch(np.arange(a, min(a + AT_ONCE, pool)))
            x = net.inputs(s, w, c)
            out[a : a + AT_ONCE] = net.logits({d: x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}, m)
        return out

    rank = strength
    for epoch in range(epochs):
        best = np.full(len(given), -1)
        for k in np.argsort(rank, kind="stable"):
            best[owner[k]] = k
        some = rng.permutation(np.flatnonzero((label[owner] == 0) & ~held[owner]))[: len(given)]
        chosen = rng.permutation(np.unique(np.concatenate([best[~held & (best >= 0)], some])))
        steps = max(len(chosen), 64 * 48)  # few rows are seen more often
        chosen = np.resize(chosen, steps)
        for a in range(0, len(chosen), 64):
            k = chosen[a : a + 64]
            net.learn(*batch(k), label[owner[k]], state, rate)
        rate *= 0.6
        rank = scored()
    top = np.full(len(given), -np.inf)
    np.maximum.at(top, owner, rank)
    fit = held & np.isfinite(top) if len(set(label[held].tolist())) == 2 and held.sum() >= 60 else np.isfinite(top)
    slope, shift = calibrated(top[fit], label[fit])
    if share and 0 < share < 1:
        shift += np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean()))
    return {"tables": [((a + b) / 2).astype(np.float16) for a, b in zip(*halves, strict=True)], "p": net.p, "slope": slope, "shift": shift}


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope (positive) and shift, by Newton steps with a small prior."""
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-4
        grad = np.array([((q - y) * x).sum() + 0.05 * (a - 1), (q - y).sum() + 0.05 * b])
        hess = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - np.clip(step[0], -1, 1), 0.05, 5)), float(np.clip(b - np.clip(step[1], -2, 2), -20, 20))
    return a, b


class Scorer:
    """A worker's network with the gates of the words it has met."""

    def __init__(self, model: dict) -> None:
        self.model = model
        if "p" in model:
            self.net = Network()
            self.net.p, self.tables = model["p"], [t.astype(np.float32) for t in model["tables"]]
            self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.gates = {d: np.zeros((1024, 3 * HIDDEN), np.float32) for d in "fb"}
        self.known = 1  # row 0 is padding

    def look_up(self, lists: list[list[str]]) -> list[np.ndarray]:
        every = set().union(*lists)
        new = list(every - self.number.keys())
        if self.known + len(new) > CACHED:  # only the words at hand are kept, the common ones among them
            kept = [w for w in every if w in self.number]
            rows = np.fromiter(map(self.number.__getitem__, kept), np.int64, len(kept))
            self.gates = {d: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), g[rows]]) for d, g in self.gates.items()}
            self.number, self.known = dict(zip(kept, range(1, len(kept) + 1), strict=True)), len(kept) + 1
        if new:
            forms = [clean(w) for w in new]
            found, whole = grams(forms)
            x = self.net.inputs(signals(self.tables, found, whole, len(new)), whole % SMALL, characters(found, len(new)))
            need = self.known + len(new)
            for d in "fb":
                if need > len(self.gates[d]):
                    grown = np.zeros((max(need, 2 * len(self.gates[d])), 3 * HIDDEN), np.float32)
                    grown[: self.known] = self.gates[d][: self.known]
                    self.gates[d] = grown
                self.gates[d][self.known : need] = x @ self.net.p[f"W{d}"] + self.net.p[f"b{d}"]
            self.number.update(zip(new, range(self.known, need), strict=True))
            self.known = need
        get = self.number.__getitem__
        return [np.fromiter(map(get, x), np.int64, len(x)) for x in lists]

    def tops(self, docs: list[np.ndarray]) -> np.ndarray:
        """The highest window's logit of each text."""
        owner, rows = [], []
        for i, d in enumerate(docs):
            at = np.array(windows(len(d)))
            owner.append(np.full(len(at), i))
            padded = d if len(d) >= WINDOW else np.pad(d, (0, WINDOW - len(d)))
            rows.append(padded[at[:, None] + np.arange(WINDOW)])
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, np.concatenate(owner), self.highest(np.concatenate(rows)))
        return top

    def highest(self, ids: np.ndarray) -> np.ndarray:
        """The logit of each window, given as a row of word numbers."""
        found = np.empty(len(ids), np.float32)
        for a in range(0, len(ids), 1024):
            part = np.ascontiguousarray(ids[a : a + 1024].T)
            gates = {d: self.gates[d][part] for d in "fb"}
            found[a : a + 1024] = self.net.logits(gates, (part > 0)[..., None].astype(np.float32))
        return found

    def score(self, given: list[str]) -> list[float]:
        if "p" not in self.model:
            return [self.model["constant"]] * len(given)
        top, lists = np.full(len(given), -np.inf), [split(t) for t in given]
        short = [i for i, words in enumerate(lists) if len(words) <= PART]
        if short:
            top[short] = self.tops(self.look_up([lists[i] for i in short]))
        for i, words in enumerate(lists):
            if len(words) > PART:  # a batch of its windows at a time, so that memory doesn't follow the text
                at = windows(len(words))
                for k in range(0, len(at), PART // STRIDE):
                    some = at[k : k + PART // STRIDE]
                    (ids,) = self.look_up([words[some[0] : some[-1] + WINDOW]])
                    top[i] = max(top[i], self.highest(ids[np.array(some)[:, None] - some[0] + np.arange(WINDOW)]).max())
        return [float(v) for v in 1 / (1 + np.exp(-np.clip(self.model["slope"] * top + self.model["shift"], -30, 30)))]


def scorer(pickled: bytes) -> Scorer:
    return held(("toxicity", hash(pickled)), lambda: Scorer(pickle.loads(pickled)))  # noqa: S301


def fit(docs: DataFrame, labels: DataFrame, *, toxic: int = TOXIC, plain: int = CLEAN, longest: int = LONGEST) -> bytes:
    """Train on a bounded sample of (doc_id, text) joined with (doc_id, toxic); null labels and texts are left out.

    The sample's ids are the least by checksum of each label, taken from the labels alone; only their texts are read
    into the driver, at most ``longest`` characters each, so the driver holds a bounded amount at any scale.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(plain))
    picked = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")
    rows = sorted(picked.select("toxic", "doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text))
    share = known.agg(F.avg("toxic")).head()[0]
    model = pickle.dumps(train([r.text for r in rows], np.array([r.toxic for r in rows]), share=share), 5)
    del rows
    given_back()
    return model


def score(docs: DataFrame, model: bytes, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted to every row. Null and empty texts are scored as a window without words. Columns of
    those names are replaced, others are kept; repeated rows get equal scores; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    carried = docs.select(*kept)
    schema = ", ".join([f"`{c}` {carried.schema[c].dataType.simpleString()}" for c in kept] + ["score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = scorer(sent.value)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                found = net.score(texts(part, text_col))
                added = [pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + added, names=[*kept, "score", "predicted"])

    return carried.mapInArrow(run, schema)


def training_rows(rows: DataFrame) -> DataFrame:
    return rows.where(crc_remainder(F.col("doc_id"), 4) != 2)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs), training_rows(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
