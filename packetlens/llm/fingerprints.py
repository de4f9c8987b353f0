"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words, runs of letters and digits in lower case. A run of more than ``LONG``
characters, as in scripts without spaces or in encoded data, has each of its characters as a unit, so
that it doesn't matter where it begins. Every ``K`` consecutive units have a rolling hash; of every
``W`` consecutive hashes the least is selected, of equal ones the rightmost; each selection is kept once
with its position, the number of its first unit. Two texts that share ``K + W - 1`` units in a row share
a selected hash, and no match of fewer than ``K`` units is seen.

The hash of units ``u`` is ``u[i] B**(K-1) + ... + u[i+K-1]`` modulo the prime ``P``, so the next one is
``(hash - u[i] B**(K-1)) B + u[i+K]``. Functions on arrays hand nothing from one entry to the next, so
the hashes of all places are made at once, those of ``2 n`` units from those of ``n``.

An entry is one number, ``hash * 2**31 + (2**31 - 1 - position)``: the least entry of a window is the
one of least hash and, among those, of largest position.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import let, unused

K, W = 3, 4
LONG = 16
_SIGN = r"[\p{L}\p{M}\p{N}]"
UNIT = rf"(?<!{_SIGN}){_SIGN}{{1,{LONG}}}+(?!{_SIGN})|{_SIGN}"
P, B = (1 << 31) - 1, 1_000_003
ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 1 << 15
SAMPLE = 20
_LAST = (1 << 31) - 1


def position(entry: Column) -> Column:
    return (F.lit(_LAST) - entry.bitwiseAND(_LAST)).cast("bigint")


def gram_hash(entry: Column) -> Column:
    return F.shiftright(entry, 31)


def _rolling(units: Column, k: int) -> Column:
    """The hash of every run of ``k`` of the numbers ``units``, by doubling the runs' length."""
    if k == 1:
        return units
    half = k // 2
    factor = pow(B, half, P)
    doubled = let(
        _rolling(units, half),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - half - 1),
            lambda i: (F.get(h, i) * factor + F.get(h, i + half)) % P,
        ),
    )
    if k % 2 == 0:
        return doubled
    return let(
        doubled,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - 2),
            lambda i: (F.get(h, i) * B + F.get(units, i + k - 1)) % P,
        ),
    )


def with_fingerprint(df: DataFrame, text: Column, to: str) -> DataFrame:
    """``df`` with the entries selected from ``text`` as the array ``to``, in order of position.

    A text of fewer than ``K`` units has one entry, for all of them; one of other characters only has one
    for the text as it is; a null or empty one has none. Each step is a column of its own, so that it is
    computed once for a row.
    """
    units, entries = unused(df.columns, f"_{to}_units"), unused(df.columns, f"_{to}_entries")
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))
    df = df.withColumn(units, F.transform(found, lambda u: F.pmod(F.xxhash64(u), F.lit(P))))
    u, e = F.col(units), F.col(entries)

    def entry(hashed: Column, at: Column) -> Column:
        return F.shiftleft(hashed, 31) + (F.lit(_LAST) - at)

    grams = let(_rolling(u, K), lambda hashed: F.transform(hashed, entry))
    whole = F.array_join(u.cast("array<string>"), " ")
    one = F.when(F.size(u) > 0, whole).otherwise(text)
    df = df.withColumn(
        entries,
        F.when(F.size(u) >= K, grams)
        .when(F.length(text) > 0, F.array(entry(F.pmod(F.xxhash64(one), F.lit(P)), F.lit(0))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    minima = F.transform(
        F.sequence(F.lit(0), F.size(e) - W), lambda i: F.least(*[F.get(e, i + j) for j in range(W)])
    )
    least = F.when(F.size(e) >= W, F.array_distinct(minima)).when(
        F.size(e) > 0, F.array(F.array_min(e))
    )
    selected = F.coalesce(least, F.array().cast("array<bigint>"))
    return df.withColumn(to, selected).drop(units, entries)


def hashes(entries: Column) -> Column:
    """The distinct hashes of entries."""
    return F.array_distinct(F.transform(entries, gram_hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def as_text(entries: Column) -> Column:
    """Entries as hexadecimal hash and position, such as ``1A2B3C4D:17``, with spaces between."""
    return F.array_join(
        F.transform(
            entries, lambda x: F.concat(F.hex(gram_hash(x)), F.lit(":"), position(x).cast("string"))
        ),
        " ",
    )


def _bucket(value: Column, bounds: list) -> Column:
    """The number of sorted ``bounds`` that are not above ``value``, by bisection; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    edges = F.array(*[F.lit(b) for b in bounds])

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(edges, middle) <= value
        return F.struct(
            F.when((s["low"] < s["high"]) & right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when((s["low"] < s["high"]) & ~right, middle).otherwise(s["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(ceil(log2(len(bounds) + 1)) + 1))
    return F.when(value.isNull(), -1).otherwise(F.aggregate(steps, start, step, lambda s: s["low"]))


def _bounds(ids: DataFrame, n: int) -> list:
    """At most ``n - 1`` ids that part all of them in ``n`` about equal ranges, whatever their type.

    Numbers by their quantiles, other types by those of the ``SAMPLE`` ids a range of least hash.
    """
    if n < 2:
        return []
    if isinstance(ids.schema["id"].dataType, T.NumericType):
        marks = [k / n for k in range(1, n)]
        found = ids.agg(F.percentile_approx("id", marks, F.lit(max(10_000, 20 * n)))).first()[0]
        return sorted(set(found or []))
    few = ids.filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n)
    ranges = few.withColumn("range", F.ntile(n).over(Window.orderBy("id")))
    least = ranges.filter("range > 1").groupBy("range").agg(F.min("id").alias("id"))
    return sorted({r.id for r in least.collect()})


def with_next(docs: DataFrame, id_column: str, text_column: str, to: str) -> tuple[DataFrame, Window]:
    """``docs`` with the text of the next row in descending id added, after the last the first.

    Ids are dealt to buckets by quantiles, and rows are ordered within their bucket only: the first
    row of a bucket is also sent to the bucket before it, where it follows the last. So texts are
    exchanged once and no task orders them all. Null ids come last, rows of equal id in order of text.
    Returns the table with those guests still in it, marked by the column ``_guest``, and the window.
    """
    spark, identity = docs.sparkSession, F.col(f"`{id_column}`")
    rows = docs.select(identity.alias("id")).agg(F.count("*").alias("n")).first()["n"]
    n = min(max(rows // ROWS_PER_BUCKET, 1), MAX_BUCKETS)
    bounds = _bounds(docs.select(identity.alias("id")), n)
    bucket = _bucket(identity, bounds)
    heads = docs.select(bucket.alias("bucket"), identity.alias("id")).groupBy("bucket").agg(F.max("id").alias("id"))
    order = sorted(heads.collect(), key=lambda r: -r.bucket)  # at most MAX_BUCKETS + 1 rows
    kind = dict(docs.dtypes)[id_column]
    sent = [(r.id, order[k - 1].bucket) for k, r in enumerate(order)]
    guests = F.broadcast(spark.createDataFrame(sent, f"_head {kind}, _before int"))
    own = F.struct(F.lit(0).alias("_guest"), bucket.alias("_bucket"))
    guest = F.struct(F.lit(1).alias("_guest"), F.col("_before").alias("_bucket"))
    dealt = docs.join(guests, identity.eqNullSafe(F.col("_head")), "left").select(
        *[f"`{c}`" for c in docs.columns],
        F.inline(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))),
    )
    window = Window.partitionBy("_bucket").orderBy(
        "_guest", identity.desc_nulls_last(), F.col(f"`{text_column}`").asc_nulls_first()
    )
    return dealt.withColumn(to, F.lead(F.struct(f"`{text_column}`")).over(window)), window


def edited_fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the fingerprints of its text and of an edited one, and likenesses.

    The edited text has its last third of characters (rounded down) replaced by the first as many of
    the next document's in descending id. Columns: id, n_chars, edited (text), entries and
    edited_entries (arrays), near_edited, near_next. Null texts count as empty.
    """
    source = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    paired, window = with_next(source, "id", "text", "next")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), n - third)
    added = F.substring(F.col("next.text"), F.lit(1), third)
    paired = paired.select(
        "id", "_guest", "_bucket", "text", n.cast("bigint").alias("n_chars"),
        F.concat(kept, F.coalesce(added, F.lit(""))).alias("edited"),
    )
    own = with_fingerprint(paired, F.col("text"), "entries").withColumn("own", hashes(F.col("entries")))
    both = own.withColumn("next", F.lead("own").over(window)).filter("_guest = 0").drop("text")
    both = with_fingerprint(both, F.col("edited"), "edited_entries")
    changed = hashes(F.col("edited_entries"))
    return both.select(
        F.col("id").alias(id_column),
        "n_chars",
        "edited",
        "entries",
        "edited_entries",
        likeness(F.col("own"), changed).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
