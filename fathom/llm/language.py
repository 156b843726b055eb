"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into phrases, each the longest that
occurs in that language's text; the language that needs the fewest phrases, each weighed by log2 of the length of its
text, explains the text best. Texts are walked in blocks, thousands at a time with numpy, whatever their lengths; a
block is then walked again from the state in which the block before it ended, until both walks meet, so that phrases
are those of the whole text. Every letter of the learned texts is a symbol of its own, whatever its script.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import crc_remainder, held, slices, table, texts

#: Bounds of what is learned from: documents of each language, characters of each, characters of all languages together.
DOCUMENTS, CHARACTERS, ALTOGETHER = 96, 40_000, 4_000_000
#: Every label is learned. A table with more labels than this is refused: its column isn't one of languages.
LABELS = 2_000
BLOCK = 256
UNDETERMINED = "und"
#: All letters lie below this code point.
_CODES = 0x32400
#: Symbols: a letter that no learned text has, a run of anything but letters, padding; learned letters follow.
UNKNOWN, SPACE, PAD, FIRST = range(4)
#: A text that needs more phrases a character than this in every language is in none of them.
FOREIGN = 0.6
_LOW = (1 << 32) - 1


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point the lower case of a letter, or 0."""
    return np.array([ord(chr(k).lower()[0]) if chr(k).isalpha() else 0 for k in range(_CODES)] + [0], np.int32)


def fold(text: str) -> np.ndarray:
    """The code points of the letters in lower case; each run of anything else is one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letters()[np.minimum(points, _CODES)]
    other = out == 0
    return out[~(other & np.r_[False, other[:-1]])]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the automaton of all substrings. State 0 is the start."""
    link, length, follow, last = [-1], [0], [{}], 0
    for c in symbols:
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        follow.append({})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                follow.append(dict(follow[q]))
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return follow


def places(follow: list[dict[int, int]]) -> list[int]:
    """A place for each state, no two alike, so that the cells place + symbol of all transitions differ."""
    width = 2 + max((max(f) for f in follow if f), default=0)
    size = sum(map(len, follow)) + len(follow) + width
    cells = starts = (1 << size) - 1  # a bit for each cell, and each place, that is free
    place = [-1] * len(follow)
    many = sorted((s for s, f in enumerate(follow) if len(f) > 1 or not s), key=lambda s: -len(follow[s]))
    for s in many:
        fits = starts
        for c in follow[s]:
            fits &= cells >> c
        if not fits:
            more = ((1 << 2 * width) - 1) << size
            size, cells, starts, fits = size + 2 * width, cells | more, starts | more, 1 << size
        at = place[s] = (fits & -fits).bit_length() - 1
        starts ^= 1 << at
        for c in follow[s]:
            cells ^= 1 << at + c
    # states with one transition take what cells are left, in order
    taken, free = {place[s] for s in many}, (i for i, bit in enumerate(reversed(bin(cells)[2:])) if bit == "1")
    last = size
    for s, f in enumerate(follow):
        if place[s] < 0 and f:
            (c,) = f
            at = next((x - c for x in free if x >= c and x - c not in taken), None)
            if at is None:
                at, last = last, last + width
            taken.add(at)
            place[s] = at
    for s, f in enumerate(follow):
        if not f and place[s] < 0:
            place[s], last = last, last + 1
    return place


def table_of(follow: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(cells, first, root): the cell at a state's place plus a symbol holds that state (upper half) and the next (lower
    half) if there is such a transition; ``first`` is where each symbol leads from the root."""
    place = places(follow)
    cells = np.full(max(place) + symbols + 1, -1 << 32, np.int64)
    for s, f in enumerate(follow):
        for c, to in f.items():
            cells[place[s] + c] = place[s] << 32 | place[to]
    first = np.full(symbols, place[0], np.int32)  # an unknown symbol is a phrase of its own
    for c, to in follow[0].items():
        first[c] = place[to]
    return cells, first, place[0]


class Languages:
    """Automata of the learned languages and the parse of texts against them."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        folded = {n: fold(samples[n]) for n in self.names}
        found = Counter(np.concatenate([np.zeros(0, np.int32), *folded.values()]).tolist())
        found.pop(0, None)
        self.symbol = np.zeros(_CODES, np.int32)
        self.symbol[0] = SPACE
        for i, (c, _) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))):
            self.symbol[c] = FIRST + i
        self.tables, self.bits = [], []
        for n in self.names:
            self.tables.append(table_of(suffix_automaton(self.symbol[folded[n]].tolist()), FIRST + len(found)))
            self.bits.append(math.log2(len(folded[n]) + 2))

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        points = fold(text)
        return self.symbol[points], bool(points.any())

    def fails(self, k: int, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each of n blocks, a (BLOCK, n) array of symbols, ends a phrase of language k. ``first``: whether a
        text begins with the block; others go on where the block before them ended."""
        cells, start, root = self.tables[k]

        def step(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell = cells.take(state + row)
            miss = cell >> 32 != state
            return np.where(miss, start.take(row), cell & _LOW), miss

        n = blocks.shape[1]
        end, alone = np.full(n, root), np.zeros(n, np.int64)
        for row in blocks:
            end, miss = step(end, row)
            alone += miss
        count, given = alone.copy(), np.where(first, root, np.r_[root, end[:-1]])
        # again from where the last block ended, beside the walk from the root, until both are in one state
        at = np.flatnonzero(given != root)
        x, y, more = np.full(len(at), root), given[at], np.zeros(len(at), np.int64)
        for row in blocks:
            if not len(at):
                break
            x, miss = step(x, row[at])
            more -= miss
            y, miss = step(y, row[at])
            more += miss
            if (met := x == y).any():
                count[at[met]] += more[met]
                at, x, y, more = at[~met], x[~met], y[~met], more[~met]
        count[at] += more
        end[at] = y
        # where a block ended in another state after all, the next ones are walked one by one
        for i in at.tolist():
            i += 1
            while i < n and not first[i] and given[i] != end[i - 1]:
                given[i] = y = int(end[i - 1])
                x, more, view = root, 0, memoryview(cells)
                for c in blocks[:, i].tolist():
                    cell = view[x + c]
                    if cell >> 32 == x:
                        x = cell & _LOW
                    else:
                        x, more = int(start[c]), more - 1
                    cell = view[y + c]
                    if cell >> 32 == y:
                        y = cell & _LOW
                    else:
                        y, more = int(start[c]), more + 1
                    if x == y:
                        break
                else:
                    end[i] = y
                count[i] = alone[i] + more
                if x == y:
                    break
                i += 1
        return count - (blocks == PAD).sum(0)

    def parse(self, given: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrases a character of each text."""
        coded = [self.symbols(t) for t in given]
        sizes = np.array([-(-len(c) // BLOCK) for c, _ in coded], np.int64)
        flat = np.full(int(sizes.sum()) * BLOCK, PAD, np.int32)
        begin = np.cumsum(sizes) - sizes
        for (c, _), b in zip(coded, begin.tolist(), strict=True):
            flat[b * BLOCK : b * BLOCK + len(c)] = c
        owner = np.repeat(np.arange(len(given)), sizes)
        first = np.zeros(len(owner), bool)
        first[begin[sizes > 0]] = True
        blocks = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        rate = np.array([np.bincount(owner, self.fails(k, blocks, first), len(given)) + 1 for k in range(len(self.names))])
        names, scores, rates = [], [], []
        for i, (c, some) in enumerate(coded):
            if not some or not self.names:
                names.append(UNDETERMINED)
                scores.append(0.0)
                rates.append(1.0)
                continue
            bits = rate[:, i] * self.bits
            order = np.argsort(bits, kind="stable")
            best, second = bits[order[0]], bits[order[1]] if len(order) > 1 else math.inf
            names.append(self.names[order[0]])
            scores.append(float(1 - best / second / 2 if math.isfinite(second) else 1.0))
            rates.append(float(rate[order[0], i] / len(c)))
        return names, scores, rates


def learn(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    documents: int = DOCUMENTS, characters: int = CHARACTERS,
) -> dict[str, str]:
    """Up to ``characters`` of text of each language, from the ``documents`` whose ids have the least checksums; less of
    each where there are so many languages that they would have over ALTOGETHER. More than LABELS are an error.

    Hashes sift the rows to about twice as many as are wanted before they are ranked, so what is shuffled doesn't grow
    with the table.
    """
    named = labelled.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != UNDETERMINED)).where(F.col(text_col).rlike(r"\p{L}"))
    rows = named.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("at"))
    counts = rows.groupBy("lang").count().limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"{lang_col} has more than {LABELS} values")
    characters = min(characters, ALTOGETHER // max(1, len(counts)))
    # the share of hashes that holds about twice the documents wanted
    upto = [(lang, 2.0**63 if n <= 2 * documents else -(2.0**63) + 2.0**65 * documents / n) for lang, n in counts]
    bounds = labelled.sparkSession.createDataFrame(upto, "of string, upto double")  # at most LABELS rows
    sifted = rows.join(F.broadcast(bounds), rows["lang"].cast("string") == bounds["of"]).where(F.col("at").cast("double") <= F.col("upto"))
    ranked = sifted.select("of", F.substring("text", 1, characters).alias("text"), "at")
    window = Window.partitionBy("of").orderBy("at", "text")
    some = ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= documents)
    out: dict[str, list[str]] = {}
    for r in sorted(some.collect(), key=lambda r: (r.of, r.rank)):
        if sum(map(len, out.setdefault(r.of, []))) < characters:
            out[r.of].append(r.text)
    return {k: "\n".join(v)[:characters] for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, str], *, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and phrase_rate (phrases a character in the language found) to every row.

    Null and letterless texts are ``und`` with score 0; a text tied between languages goes to the first by name; the
    score is one half in a tie and grows towards 1. Columns of those names are replaced, others are kept. An empty
    table gives no rows; without any learned language every text is ``und``. The automata are built once and sent to
    the workers: about 40 bytes a learned character, of which there are ALTOGETHER at most.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Languages(samples), 5))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "phrase_rate")]
    carried = docs.select(*kept)
    schema = ", ".join([f"`{c}` {carried.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string, score double, phrase_rate double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("languages", hash(sent.value)), lambda: pickle.loads(sent.value))  # noqa: S301
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                names, scores, rates = model.parse(texts(part, text_col))
                added = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + added, names=[*kept, "lang_pred", "score", "phrase_rate"])

    return carried.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_remainder(F.col("doc_id"), 5) != 0)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
