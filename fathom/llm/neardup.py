"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on whole shingle sets.

A document's signature is SYMBOLS MinHash values of BITS bits. Split into CHUNKS parts, two signatures that differ in
at most RADIUS = 2 * CHUNKS - 1 symbols differ in at most one symbol of some part; so the parts with each one symbol
left out in turn, five keys a part, meet for every such pair. Documents with equal shingle sets are one class first.

Within keys shared by many, pairs are not listed: a class is first required to have enough shingles that any other
candidate has too, then compared with the best supported class of each key. Links found so far join classes to
components; of pairs that still lie in different components and share a key, those are compared then that share a rare
shingle, or that can be similar by their frequent shingles alone and are near by a longer signature of single bits, each
at the first key it has. So in a large group of near copies, sets that differ from it in changes of their own, or in
ones that few others share, are not compared with all of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import held, slices, stored, table
from fathom.llm.components import components

SYMBOLS, CHUNKS, BITS = 50, 10, 16
WIDTH = SYMBOLS // CHUNKS
RADIUS = 2 * CHUNKS - 1
#: One-bit values that may speak for a pair beyond RADIUS after the first round.
FINE = 2048
#: Signatures as 64-bit numbers of four symbols each.
NUMBERS = -(-SYMBOLS * BITS // 64)
#: Sets of a shingle that is met by itself; pairs without such a one share no more than their commoner shingles.
FREQUENT = 128
#: Tables of at most so many ids (8 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 300_000
CACHED = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_B = np.random.default_rng(20240502).integers(1 << 32, 1 << 63, (2, FINE), np.uint64) | np.uint64(1)
_A = np.random.default_rng(20240501).integers(1 << 32, 1 << 63, (2, SYMBOLS), np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps the hashes of words it has met."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, {}

    def sets(self, given: list[str]) -> list[np.ndarray]:
        # bytes.lower and bytes.split act on ASCII alone, which is the definition of a word here
        lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in given]
        new = set().union(*lists) - self.words.keys()
        if len(self.words) + len(new) > CACHED:
            self.words, new = {}, set().union(*lists)
        self.words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        counts = np.array([len(x) for x in lists], np.int64)
        get, total = self.words.__getitem__, int(counts.sum())
        flat = np.fromiter((get(w) for x in lists for w in x), np.uint64, total)
        n, out, at = self.size, [], 0
        with np.errstate(over="ignore"):
            if total >= n:
                h = np.zeros(total - n + 1, np.uint64)
                for i in range(n):
                    h = mixed(h * np.uint64(31) + flat[i : total - n + 1 + i] + np.uint64(i + 1))
            for k in counts.tolist():
                if k >= n:
                    out.append(np.unique(h[at : at + k - n + 1]))
                elif k:
                    whole = np.uint64(k)
                    for w in flat[at : at + k]:
                        whole = mixed(whole * np.uint64(31) + w)
                    out.append(np.array([whole], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
                at += k
        return out


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """SYMBOLS 16-bit symbols of each set; an empty set has none."""
    full = [s for s in sets if len(s)]
    if not full:
        return [b""] * len(sets)
    flat, sizes = np.concatenate(full), np.array([len(s) for s in full])
    starts, out = np.cumsum(sizes) - sizes, np.empty((len(full), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for i in range(SYMBOLS):
            least = np.minimum.reduceat(flat * _A[0, i] + _A[1, i], starts)
            out[:, i] = (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    rows = iter(out)
    return [next(rows).tobytes() if len(s) else b"" for s in sets]


def shingler(size: int) -> Shingler:
    return held(("shingles", size), lambda: Shingler(size))


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, digest, sig) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingler(size).sets([x or "" for x in part.column("text").to_pylist()])
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                arrays = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, sig binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, n, hashes) of (doc_id, text); hashes are the sorted set's 64-bit values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingler(size).sets([x or "" for x in part.column("text").to_pylist()])
                arrays = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["rep", "n", "hashes"])

    return docs.mapInArrow(run, "rep bigint, n bigint, hashes binary")


def one_by_one(sets: DataFrame) -> DataFrame:
    """(rep, n, h): a row for each shingle of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "hashes", 2 << 20):
                raw = part.column("hashes").to_pylist()
                sizes = [len(x) // 8 for x in raw]
                flat = np.frombuffer(b"".join(raw), np.int64)
                arrays = [pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(flat, pa.int64())], names=["rep", "n", "h"])

    return sets.mapInArrow(run, "rep bigint, n bigint, h bigint")


def keyed(classes: DataFrame, *more: str) -> DataFrame:
    """(rep, key, *more): each signature's chunks with one symbol left out in turn."""
    b = BITS // 8

    def key(j: int, t: int):
        a = j * WIDTH * b
        parts = [F.substring("sig", a + 1, t * b), F.substring("sig", a + (t + 1) * b + 1, (WIDTH - 1 - t) * b)]
        return F.xxhash64(F.lit(j * WIDTH + t), *parts)

    keys = F.array(*[key(j, t) for j in range(CHUNKS) for t in range(WIDTH)])
    return classes.select("rep", *more, F.explode(keys).alias("key"))


def few(ids: DataFrame):
    """A broadcast hint for a stored table of ids where it is small, and none beyond."""
    return F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df)


def supported(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(h, c), the shingles of more than one set and how many have them; and (rep, c, p) of sets of which enough
    shingles, c, stand in another set too, p of them in more than FREQUENT: without that no link is possible, since a
    linked pair shares at least ``percent`` of each one's shingles."""
    rows = one_by_one(sets)
    shared = stored(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    often = shared.select("h", (F.col("c") > FREQUENT).alias("often"))
    found = rows.join(often, "h").groupBy("rep", "n").agg(F.count("*").alias("c"), F.count_if("often").alias("p"))
    return shared, found.where(F.col("c") * 100 >= F.col("n") * percent).select("rep", "c", "p")


def by_rare(rows: DataFrame, sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``rows`` in different components that may be similar enough and share a shingle of at most FREQUENT
    sets. The rarest shingle that a linked pair shares is among each one's rarest, of which there are one more than it
    may lack in the other; so a set meets others through few shingles, and through each no more than FREQUENT."""
    own = one_by_one(sets.join(few(rows)(rows.select("rep")), "rep", "left_semi")).join(shared, "h")
    order = Window.partitionBy("rep").orderBy("c", "h")
    ranked = own.select("rep", "h", "c", F.row_number().over(order).alias("rank")).where(F.col("c") <= FREQUENT)
    first = ranked.withColumnRenamed("c", "times").join(rows, "rep").where((F.col("rank") - 1 + F.col("n") - F.col("c")) * 100 <= F.col("n") * (100 - percent))
    first = stored(first.select("rep", "h", "n", "c", "component"))
    a, b = (first.select("h", *[F.col(x).alias(f"{x}_{k}") for x in ("rep", "n", "c", "component")]) for k in "ab")
    pairs = a.join(b, "h").where("component_a <> component_b and rep_a < rep_b").where(possible(percent))
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sets have 100 * intersection >= percent * union. The rarer side is fetched first; a side
    that many pairs name is split by adaptive skew handling."""
    left, right = (sets.select(F.col("rep").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ok = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def sharpened(sets: DataFrame) -> DataFrame:
    """(rep, g0, ..., f0, ...): each set's signature, four symbols to a number, and FINE more one-bit MinHash values, 64
    to a number."""
    names = [f"g{i}" for i in range(NUMBERS)] + [f"f{i}" for i in range(FINE // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "hashes", 1 << 20):
                raw = part.column("hashes").to_pylist()
                sizes = np.array([len(x) // 8 for x in raw])
                flat, bits = np.frombuffer(b"".join(raw), np.uint64), np.zeros((len(raw), FINE), np.uint8)
                with np.errstate(over="ignore"):
                    for i in range(FINE):
                        bits[:, i] = (mixed(np.minimum.reduceat(flat * _B[0, i] + _B[1, i], np.cumsum(sizes) - sizes)) >> np.uint64(7)) & np.uint64(1)
                own = b"".join(x.ljust(8 * NUMBERS, b"\0") for x in signatures(np.split(flat, np.cumsum(sizes)[:-1])))
                numbers = np.concatenate([np.frombuffer(own, np.int64).reshape(-1, NUMBERS), np.packbits(bits, axis=1).view(np.int64)], 1)
                arrays = [pa.array(numbers[:, i].copy(), pa.int64()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column("rep"), *arrays], names=["rep", *names])

    return sets.select("rep", "hashes").mapInArrow(run, "rep bigint, " + ", ".join(f"{n} bigint" for n in names))


def within(a: str = "a", b: str = "b"):
    """Whether two signatures differ in at most RADIUS symbols: of each 16-bit lane of their difference, any bit."""

    def lanes(i: int):
        x = F.col(f"g{i}_{a}").bitwiseXOR(F.col(f"g{i}_{b}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return sum((lanes(i) for i in range(NUMBERS)), F.lit(0)) <= RADIUS


def close(percent: int, a: str = "a", b: str = "b"):
    """Whether the one-bit values differ no more often than five deviations above a linked pair's mean."""
    p = (1 - percent / 100) / 2
    most = int(FINE * p + 5 * (FINE * p * (1 - p)) ** 0.5) + 1
    apart = sum((F.bit_count(F.col(f"f{i}_{a}").bitwiseXOR(F.col(f"f{i}_{b}"))) for i in range(FINE // 64)), F.lit(0))
    return apart <= most


def span(percent: int):
    """A set's size by powers of 100 / percent: linked sets are at most one apart."""
    return F.floor(F.log("n") / F.lit(np.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")


def possible(percent: int, a: str = "a", b: str = "b", c: str = "c"):
    """Whether two sets of n shingles, c of them not theirs alone, can be similar enough: what they share is at most
    the lesser c, and what they hold together is the sum of n less that."""
    most = F.least(f"{c}_{a}", f"{c}_{b}")
    return most * 100 >= (F.col(f"n_{a}") + F.col(f"n_{b}") - most) * percent


def links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes that join every pair of classes as similar as ``percent`` and within
    RADIUS, directly or through others. ``classes`` has rep, n, sig; ``docs`` has doc_id, text."""
    keys = keyed(classes, "n")
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    active = stored(keys.join(shared, "key").select("rep").distinct())
    hint = few(active)
    chosen = docs.join(hint(active), docs["doc_id"] == active["rep"], "left_semi")
    sets = stored(shingle_sets(chosen, size))
    shared, viable = supported(sets, percent)
    viable = stored(viable)
    hint = few(viable)
    rows = stored(classes.join(hint(viable), "rep"))
    sets = sets.join(hint(viable.select("rep")), "rep", "left_semi")
    # one pair for each member of a key and the key's best supported class
    keys = keyed(rows, "n", "c")
    leader = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("rep")).alias("first"), "n", "c"))
    best = stored(keys.groupBy("key").agg(F.count("*").alias("k"), leader.alias("top")).where("k > 1").select("key", "top"))
    stars = keys.join(best, "key").select(
        (-F.col("top.first")).alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"),
        F.col("top.n").alias("n_a"), F.col("top.c").alias("c_a"),
    )
    stars = stored(stars.where("a <> b").where(possible(percent)).select("a", "b").distinct())
    found = stored(confirmed(stars, sets, percent))
    # what may still link different components: members of a key outside its largest one, against all of the key
    part = components(found)
    marked = stored(rows.join(part, rows["rep"] == part["node"], "left").select("rep", "n", "c", "p", "sig", F.coalesce("component", "rep").alias("component")))
    number = keyed(marked, "n", "c", "p", "component")
    counts = number.groupBy("key", "component").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    mixed_keys = counts.groupBy("key").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"), F.min("least").alias("least"))
    mixed_keys = stored(mixed_keys.where("parts > 1").select("key", "least", F.col("top.component").alias("largest")))

    def hopeful(c: str):
        """Whether a set can be similar enough to its best match in the key, one of c shingles, or the smallest there is."""
        near_n = F.greatest("least", c)
        return F.col(c) * 100 >= (F.col("n") + near_n - F.col(c)) * percent

    open_keys = stored(number.join(mixed_keys, "key").where(hopeful("c")))
    open_rows = stored(open_keys.select("rep", "n", "c", "component").distinct())
    rare = by_rare(open_rows, sets, shared, percent)
    # pairs without a rare shingle in common share at most the lesser p
    open_keys = open_keys.where(hopeful("p"))
    open_reps = stored(open_keys.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys")))  # at most SYMBOLS keys
    hint = few(open_reps)
    fine = sharpened(sets.join(hint(open_reps.select("rep")), "rep", "left_semi"))
    open_rows = stored(open_keys.join(stored(open_reps.join(fine, "rep")), "rep"))
    names = ["rep", "n", "p", "component", "keys", *[f"g{i}" for i in range(NUMBERS)], *[f"f{i}" for i in range(FINE // 64)]]
    spans = F.explode(F.sequence(span(percent) - 1, span(percent) + 1)).alias("span")
    a = open_rows.where("component <> largest").select("key", spans, "largest", *[F.col(x).alias(f"{x}_a") for x in names])
    b = open_rows.select("key", span(percent).alias("span"), *[F.col(x).alias(f"{x}_b") for x in names])
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    pairs = a.join(b, ["key", "span"]).where("component_a <> component_b and (component_b = largest or rep_a < rep_b)")
    pairs = pairs.where(possible(percent, c="p")).where(within() | close(percent)).where(once)
    rest = stored(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(rare).distinct())
    return found.unionByName(confirmed(rest, sets, percent))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the set's size, the least id reachable over links, and
    whether it is the row's own.

    A text with fewer words than a shingle has its whole sequence as one; one without words, or null, has none and is
    linked with nothing. Rows of null id are in no component and kept. Repeated rows share their id's component and
    are all kept or not. Other columns are not read; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = stored(signed(given, words))
    usable = sigs.where("n > 0 and doc_id is not null")
    classes = stored(usable.groupBy("digest", "n", "sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    found = links(classes.select("rep", "n", "sig"), given, words, percent)
    part = stored(components(found))
    joined = classes.join(part, classes["rep"] == part["node"], "left").where("component is not null or rep <> last")
    named = stored(joined.select("digest", F.coalesce("component", "rep").alias("component")))
    own = F.when(F.col("n") > 0, F.col("component"))
    return sigs.join(named, "digest", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op10_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS h FROM n),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
d AS (SELECT DISTINCT a, b FROM u)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(m.c, n.doc_id) AS component_id, coalesce(m.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN (
  WITH RECURSIVE g(node, z) AS (SELECT a, a FROM d UNION SELECT g.node, d.b FROM g JOIN d ON d.a = g.z)
  SELECT node, min(z) AS c FROM g GROUP BY node) m ON m.node = n.doc_id
"""
