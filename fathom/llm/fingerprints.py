"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests, in DataFrame functions alone.

A text of any length is cut into paragraphs, at sentence and line ends, each hashed to 64 bits. A sketch
of 3 * s cells holds in each cell the number, the xor of digests and the xor of digest checks of the paragraphs that
fall there, one cell in each third. Two versions' sketches are subtracted cell by cell; cells left with one digest give
it away, and taking it out of its other cells uncovers more, until the paragraphs that differ are known. Where that
gets stuck, sketches with cells for all paragraphs of both are built, twice if need be, and at last the digests are
compared themselves, so that the likeness is exact in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import table

#: Cells in each third of a fingerprint.
THIRD = 10
ROUNDS = 6
#: Digests of both sides that share a sketch when a fingerprint's own cells don't suffice.
GROUP = 10
SENTENCES = r"[.!?\r\n][.!? \t\r\n]*"


def let(value: Column, body) -> Column:
    """body(value) with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column, pattern: str) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; blank ones don't count."""
    units = F.filter(F.split(text, pattern), lambda u: F.trim(u) != "")
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def own_digests(text: Column) -> Column:
    return digests(text, SENTENCES)


def check(key: Column) -> Column:
    return F.hash(key, F.lit(7))


def cell(n: Column, x: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), x.cast("bigint").alias("x"), c.cast("int").alias("c"))


def added(entries: Column, to: Column, i: Column, sign: int) -> Column:
    """The cell ``to`` with the digests that fall in cell ``i`` put in or taken out."""
    return F.aggregate(
        F.filter(entries, lambda e: e["p"] == i), to,
        lambda a, e: cell(a["n"] + e["n"] * sign, a["x"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])),
    )


def placed(signed: Column, j: int, third: Column) -> Column:
    """Signed digests with their cell in third j."""
    at = lambda k: F.pmod(F.xxhash64(k, F.lit(j)), third).cast("int")
    return F.transform(signed, lambda e: F.struct(at(e["k"]).alias("p"), e["k"].alias("k"), e["n"].alias("n"), check(e["k"]).alias("c")))


def sketch(signed: Column, third: Column) -> Column:
    """struct(t0, t1, t2): the cells of a set of signed digests, (k, n) each."""
    zero, numbers = cell(F.lit(0), F.lit(0), F.lit(0)), F.sequence(F.lit(0), (third - 1).cast("int"))

    def cells(j: int) -> Column:
        return let(placed(signed, j, third), lambda entries: F.transform(numbers, lambda i: added(entries, zero, i, 1)))

    return F.struct(*[cells(j).alias(f"t{j}") for j in range(3)])


def signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("n")))


def subtracted(ours: Column, theirs: Column) -> Column:
    less = lambda a, b: cell(a["n"] - b["n"], a["x"].bitwiseXOR(b["x"]), a["c"].bitwiseXOR(b["c"]))
    return F.struct(*[F.zip_with(ours[f"t{j}"], theirs[f"t{j}"], less).alias(f"t{j}") for j in range(3)])


def peeled(left: Column, third: Column) -> Column:
    """struct(done, only_ours, only_theirs) from the difference of two sketches."""
    nothing = F.array().cast("array<struct<k:bigint,n:int>>")
    start = F.struct(left.alias("cells"), nothing.alias("found"), F.lit(False).alias("stuck"))
    all_of = lambda cells: F.concat(*[cells[f"t{j}"] for j in range(3)])

    def peel(state: Column, _: Column) -> Column:
        pure = F.filter(all_of(state["cells"]), lambda c: (F.abs(c["n"]) == 1) & (c["c"] == check(c["x"])))
        keys = F.array_distinct(F.transform(pure, lambda c: F.struct(c["x"].alias("k"), c["n"].alias("n"))))

        def without(some: Column) -> Column:
            def rest(j: int) -> Column:
                return let(placed(some, j, third), lambda entries: F.transform(state["cells"][f"t{j}"], lambda c, i: added(entries, c, i, -1)))

            cells = F.struct(*[rest(j).alias(f"t{j}") for j in range(3)])
            return F.struct(cells.alias("cells"), F.concat(state["found"], some).alias("found"), F.lit(False).alias("stuck"))

        stop = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("stuck"))
        return F.when(state["stuck"], state).otherwise(let(keys, lambda some: F.when(F.size(some) == 0, stop).otherwise(without(some))))

    def told(end: Column) -> Column:
        left_over = F.exists(all_of(end["cells"]), lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))
        count = lambda sign: F.size(F.filter(end["found"], lambda p: p["n"] == sign))
        return F.struct((~left_over).alias("done"), count(1).alias("only_ours"), count(-1).alias("only_theirs"))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, peel), told)


def compared(ours: Column, theirs: Column, first: Column) -> Column:
    """The difference of two sets of digests; ``first`` is what their fingerprints gave.

    Where that is stuck, the digests of both are cut, in their order, into groups of about ``GROUP``, each with a sketch
    of more cells than it has digests; sketches are linear, so one of digests signed +1 and -1 is the two sides' difference.
    A group that is stuck again is tried with four times as many, and then compared digest by digest.
    """

    def tried(group: Column, times: float) -> Column:
        third = F.ceil(F.size(group) * F.lit(times) / 3).cast("int") + 3
        return let(third, lambda t: peeled(sketch(group, t), t))

    def exact(group: Column) -> Column:
        side = lambda sign: F.transform(F.filter(group, lambda e: e["n"] == sign), lambda e: e["k"])
        return F.struct(
            F.lit(True).alias("done"), F.size(F.array_except(side(1), side(-1))).alias("only_ours"),
            F.size(F.array_except(side(-1), side(1))).alias("only_theirs"),
        )

    def one(group: Column) -> Column:
        larger = lambda: let(tried(group, 4.0), lambda d: F.when(d["done"], d).otherwise(exact(group)))
        return let(tried(group, 1.5), lambda d: F.when(d["done"], d).otherwise(larger()))

    def second() -> Column:
        both = F.sort_array(F.concat(signed(ours, 1), signed(theirs, -1)))
        last = F.greatest(F.ceil(F.size(both) / F.lit(GROUP)).cast("int") - 1, F.lit(0))

        def cut(all_of: Column) -> Column:
            # a digest of both sides stands there twice, side by side, and stays in one group
            same = lambda i: F.coalesce((F.get(all_of, i * GROUP)["k"] == F.get(all_of, i * GROUP - 1)["k"]).cast("int"), F.lit(0))
            start = lambda i: i * GROUP + same(i)
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_of, start(i) + 1, start(i + 1) - start(i)))

        parts = let(both, cut)
        zero = F.struct(F.lit(True).alias("done"), F.lit(0).alias("only_ours"), F.lit(0).alias("only_theirs"))
        return F.aggregate(
            F.transform(parts, one), zero,
            lambda a, d: F.struct(
                F.lit(True).alias("done"), (a["only_ours"] + d["only_ours"]).alias("only_ours"), (a["only_theirs"] + d["only_theirs"]).alias("only_theirs")
            ),
        )

    return let(first, lambda d: F.when(d["done"], d).otherwise(second()))


def likeness(ours: Column, theirs: Column, found: Column) -> Column:
    """Paragraphs in both over paragraphs in either; 1 where neither text has any."""
    def share(d: Column) -> Column:
        both, either = F.size(ours) - d["only_ours"], F.size(ours) + d["only_theirs"]
        return F.when(either == 0, 1.0).otherwise(both / F.when(either != 0, either))

    return let(found, share)


def written(cells: Column) -> Column:
    """A sketch as text: count, digests and checks of each cell in hexadecimal."""
    one = lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["x"]), F.lit("."), F.hex(c["c"]))
    return F.concat(F.lit(f"ibf{THIRD}:"), F.array_join(F.transform(F.concat(*[cells[f"t{j}"] for j in range(3)]), one), ","))


def place(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by halving."""
    if not bounds:
        return F.lit(0)
    given = F.lit(bounds).cast("array<bigint>") if len(bounds) > 1 else F.array(F.lit(bounds[0]).cast("bigint"))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(given, mid) <= column
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        )

    return F.aggregate(steps, start, halve)["lo"]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each document's text and that of the next lower id; after the lowest comes the highest.

    Documents are dealt once, by ranges of ids found from their approximate quantiles; in each range the next row is at
    hand, and a range's last row takes the first of the range below, of which there is one row each.
    """
    ranges = 8 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    given = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = given.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).head()
    bounds = sorted(set(cuts.q or [])) if cuts and ranges > 1 else []
    dealt = given.withColumn("range", place(F.col("key"), bounds))
    order = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("text"))
    rows = dealt.withColumn("after", F.lead("text").over(order))
    # one row for each range: the highest id by a hash aggregate of ids, then its text
    tops = dealt.groupBy("range").agg(F.max("key").alias("key"))
    firsts = given.join(F.broadcast(tops), "key").groupBy("range").agg(F.max(F.struct("key", "text")).alias("top"))
    around = Window.orderBy(F.desc("range"))  # over one row for each range
    following = firsts.select(
        F.col("range").alias("of"), F.coalesce(F.lead("top").over(around), F.first("top").over(around))["text"].alias("first")
    )
    joined = rows.join(following, (F.col("range") == F.col("of")) & F.col("after").isNull(), "left")
    return joined.select("id", "text", F.coalesce("after", "first").alias("next"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Null text counts as empty: it has no paragraphs, and is wholly like another text without any. Repeated paragraphs
    count once. Of equal ids the greater text comes first; null ids come last. A single document is followed by
    itself. Other columns are not read; an empty table gives no rows.
    """
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next"), F.lit(1), part))
    rows = with_next(docs, id_col, text_col).select("id", n.cast("bigint").alias("n_chars"), "text", "next", edited.alias("edited"))
    third = F.lit(THIRD)
    keyed = rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        own_digests(F.col("text")).alias("a"), own_digests(F.col("edited")).alias("b"), own_digests(F.col("next")).alias("c"),
    )
    cells = keyed.select("*", *[sketch(signed(F.col(k), 1), third).alias(f"s{k}") for k in "abc"])
    side = lambda k: F.struct(F.col("a").alias("a"), F.col(k).alias("b"), F.col("sa").alias("x"), F.col(f"s{k}").alias("y"))
    sides = F.array(side("b"), side("c"))  # the two comparisons of a document, worked out by one expression

    def near(p: Column) -> Column:
        return likeness(p["a"], p["b"], compared(p["a"], p["b"], peeled(subtracted(p["x"], p["y"]), third)))

    return cells.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"),
        written(F.col("sb")).alias("edited_fingerprint"), F.transform(sides, near).alias("near"),
    ).select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
