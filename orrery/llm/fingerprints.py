"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import documents, few, named, stored

BINS, BITS, WORDS = 128, 8, 5
#: Probes that a bin tries one after the other before it looks through all that are left.
TRIES = 12
BUCKET_BYTES = 16 << 20
#: Quantiles of ids that bound ranges, and again quantiles that bound the pieces of a range: both are literals or rows of bounded number.
MOST_BOUNDS = 500
#: Ranges that one window looks at to find their successors.
FAN = 1024


@lru_cache(4)
def probes(bins: int) -> list[list[int]]:
    """For each bin all others in an order of its own, drawn by hashing: probe t of bin i depends on i and t alone."""
    drawn = lambda i, j: blake2b(f"{i}/{j}".encode(), digest_size=8).digest()
    return [sorted((j for j in range(bins) if j != i), key=lambda j, i=i: drawn(i, j)) for i in range(bins)]


def _numbers(rows: list[list[int]]) -> Column:
    """A literal array of arrays."""
    return F.from_json(F.lit(str(rows)), "array<array<int>>")


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """array<bigint>: a hash for each run of `width` words (lower-cased, between ASCII white space); one of all words where they are fewer; none without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(n >= width, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _bound(words, hashed)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, width: int = WORDS) -> Column:
    """array<smallint> of `bins` numbers below 2^bits; an empty array for texts without words.

    Each shingle is hashed once. Its upper bits name its bin, and a bin keeps its least hash. An empty bin copies the first
    filled bin of its own probe order (optimal densification). Of the least hashes the low bits are kept.
    """
    shift = 64 - (bins.bit_length() - 1)
    if bins != 1 << (64 - shift):
        raise ValueError("bins: a power of two")
    orders = probes(bins)
    first = _numbers([[o[t] for o in orders] for t in range(min(TRIES, bins - 1))])
    every = _numbers(orders)
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")

    def filled(least: Column) -> Column:
        """least: ascending, one hash for each bin that is not empty."""
        at = F.map_from_arrays(F.transform(least, bin_of), least)
        slots = _bound(at, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.element_at(m, i.cast("int"))))

        def dense(v: Column) -> Column:
            def value(i: Column) -> Column:
                tried = [F.get(v, F.get(F.get(first, F.lit(t)), i)) for t in range(min(TRIES, bins - 1))]
                rest = F.get(F.filter(F.transform(F.get(every, i), lambda j: F.get(v, j)), lambda x: x.isNotNull()), F.lit(0))
                return F.coalesce(F.get(v, i), *tried, rest)

            return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: value(i.cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).cast("smallint"))

        return _bound(slots, dense)

    def kept(h: Column) -> Column:
        least = F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))
        return F.when(F.size(h) > 0, _bound(least, filled)).otherwise(F.array().cast("array<smallint>"))

    # Signed order is not that of the bins, but keeps each bin together, its least hash first.
    return _bound(F.array_sort(shingle_hashes(text, width)), kept)


def packed(bins: Column, bits: int = BITS) -> Column:
    """Hexadecimal string of a fingerprint, bits / 4 digits for each bin."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), -(-bits // 4), "0"))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated resemblance, 0 to 1, of two fingerprints; low bits that agree by chance are allowed for.

    Two texts without words are alike (1), one such and another text not at all (0).
    """
    chance = 1 / (1 << bits)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    share = same / F.greatest(F.size(a), F.size(b), F.lit(1))
    known = F.greatest(F.lit(0.0), (share - F.lit(chance)) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(known)


def _slot(key: Column, bounds: list, hot: set) -> Column:
    """The key's place among the bounds, found by halving: ascending with the key, null keys at 0 and each hot bound in a place of its own."""

    def within(low: int, high: int) -> Column:
        if high - low == 1:
            own = 2 + 2 * low
            return F.when(key == F.lit(bounds[low]), F.lit(own)).otherwise(F.lit(own + 1)) if low >= 0 and bounds[low] in hot else F.lit(own + 1)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), within(low, middle)).otherwise(within(middle, high))

    return F.coalesce(F.when(key.isNotNull(), within(-1, len(bounds))), F.lit(0)).cast("long")


def successors(ranges: DataFrame, most: int) -> DataFrame:
    """(range, next) for each row of ranges (range, long; at most `most` rows below that number): the least greater range; null for the last.

    No window holds more than FAN rows: ranges are looked at in groups, and a group's last range gets the first range of the next group.
    """
    if most <= FAN:
        return ranges.select("range", F.lead("range").over(Window.orderBy("range")).alias("next"))
    group = F.floor(F.col("range") / F.lit(FAN)).cast("long")
    inside = Window.partitionBy("group").orderBy("range")
    own = ranges.select("range", group.alias("group")).withColumn("next", F.lead("range").over(inside))
    firsts = own.groupBy("group").agg(F.min("range").alias("first"))
    after = successors(firsts.select(F.col("group").alias("range")), -(-most // FAN)).select(F.col("range").alias("group"), F.col("next").alias("group_after"))
    first_after = after.join(firsts.select(F.col("group").alias("group_after"), F.col("first").alias("next_first")), "group_after").select("group", "next_first")
    return own.join(first_after, "group", "left").select("range", F.coalesce("next", "next_first").alias("next"))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next text, by ascending id; after the last comes the first. near_edited and near_next are the likeness of the text's fingerprint to
    the edited text's and to the next text's. Null texts are empty; texts without words have an empty fingerprint.
    Rows of equal ids follow one another by text; null ids come first. One row is its own next. An empty
    table gives no rows; other columns are left out, whatever their names. Texts of any length are taken whole.

    The order needs no sort in one task: ids fall into ranges of about BUCKET_BYTES by approximate quantiles of all ids, large ranges into pieces
    by quantiles of their own, and an id that holds much of the table (or the null id) by quantiles of its texts' beginnings. Each range looks one row
    ahead, and its last row takes the first row of the next range. What is known of ranges stays in tables. Each text is shuffled once.
    """
    work = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    size, rows, nulls = work.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    ranges = int(max(1, min(max((size or 0) // BUCKET_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), rows)))
    top = min(ranges, MOST_BOUNDS)
    quantiles = work.agg(F.percentile_approx("id", [i / top for i in range(top + 1)], 20 * top)).first()[0] or []
    bounds = sorted(set(quantiles))
    hot = {v for v in bounds if quantiles.count(v) > 1} if top > 1 else set()
    slot = _slot(F.col("id"), bounds, hot)
    # A place of one id is cut by quantiles of its texts' first bytes, any other by quantiles of its ids.
    pieces = min(MOST_BOUNDS, -(-ranges // top))
    of_one = min(MOST_BOUNDS, max(pieces, ranges)) if hot or nulls else 1
    is_one = F.col("id").isNull() | F.col("id").isin(*hot) if hot else F.col("id").isNull()
    turn = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    work = work.select("*", slot.alias("slot"), turn.alias("turn"))
    inner = F.lit(0).cast("long")
    parts = lambda value, n: F.percentile_approx(value, [i / n for i in range(1, n)], 20 * n)
    quantiles = [parts(F.when(is_one, F.col("turn")), of_one)] * (of_one > 1) + [parts(F.when(~is_one, F.col("id")), pieces)] * (pieces > 1)
    if quantiles:
        cuts = work.groupBy("slot").agg(F.array_distinct(F.coalesce(*quantiles)).alias("cuts"))
        work = work.join(few(stored(cuts), 2 * MOST_BOUNDS + 4), "slot", "left")
        value = F.when(is_one, F.col("turn")).otherwise(F.col("id"))
        inner = F.coalesce(F.size(F.filter("cuts", lambda c: c <= value)), F.lit(0)).cast("long")
    work = work.select("id", "text", "turn", (F.col("slot") * F.lit(MOST_BOUNDS) + inner).alias("range"))
    made = work.select("id", "text", "turn", F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("text"), bins, bits).alias("bins"), "range")
    order = Window.partitionBy("range").orderBy("id", "text")
    ahead = made.select("*", F.lead("text").over(order).alias("next_text"), F.lead("bins").over(order).alias("next_bins"))

    # The first row of each range, for the last row of the one before: found by ids and texts' beginnings, then its text is fetched.
    firsts = stored(work.groupBy("range").agg(F.min(F.struct("id", "turn")).alias("first")))
    least = firsts.agg(F.min("range")).first()[0]
    after = successors(firsts.select("range"), (2 * len(bounds) + 3) * MOST_BOUNDS).select(F.col("range").alias("at"), F.coalesce("next", F.lit(least)).alias("range"))
    places = stored(firsts.join(after, "range").select("at", "range", "first.id", "first.turn"))
    heads = work.join(few(places, 4 * MOST_BOUNDS).select("at", F.col("range").alias("of"), F.col("id").alias("first_id"), F.col("turn").alias("first_turn")), (F.col("range") == F.col("of")) & (F.col("turn") == F.col("first_turn")) & F.col("id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy(F.col("at").alias("range")).agg(F.min("text").alias("head_text"))
    heads = heads.select("range", "head_text", fingerprint(F.col("head_text"), bins, bits).alias("head_bins"))
    every = ahead.join(heads.hint("merge"), "range", "left").select("id", "text", "n_chars", "bins", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_bins", "head_bins").alias("next_bins"))

    cut = F.floor(F.col("n_chars") / F.lit(4)).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next_text", F.lit(1), cut))
    done = every.select("*", edited.alias("edited")).select("id", "n_chars", "bins", "next_bins", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited"), bins, bits).alias("edited_bins"))
    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", packed(F.col("bins"), bits).alias("fingerprint"), packed(F.col("edited_bins"), bits).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins"), bits).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins"), bits).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_fingerprints(documents(spark, sf_dir))
