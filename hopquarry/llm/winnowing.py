"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is cut into units: runs of at most ``UNIT`` code points without ASCII
white space.  Each ``K`` units in a row have a hash, rolled on by doubling (two
neighbouring hashes make that of twice the length).  Of every ``WINDOW`` hashes
in a row the least is selected, the rightmost on ties, and kept with its
position.  So two texts that share ``K + WINDOW - 1`` units in a row share a
selected hash there, and a hash selected in a run depends on that run alone.

A selected entry is one number: 39 bits of hash above 24 bits that hold the
position from the end, so that the least number is also the rightmost of equal
hashes.  A fingerprint's text lists ``hash:position`` in order of position; the
likeness of two fingerprints is the Jaccard index of their hashes.

Units are counted from the last white space: a passage without any that starts
elsewhere in its run has other units, and only passages with white space are sure
to be found.

Successors come without a global sort: approximate quantiles cut the ids into
buckets of like size, each bucket gets the first row of the next as a last row
that is not its own, and one window per bucket does the rest.

Defined results: null and empty texts have an empty fingerprint, and two empty
fingerprints are alike (1.0); texts of fewer than ``K`` units have one hash of
all; repeated ids follow one another in order of a hash of
their texts; a null id comes
first; a single document is its own successor; extra columns are dropped; an
empty table gives an empty table; positions from 2 ** 24 - 1 on share that one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import text_or_empty

UNIT = 6
K = 4
WINDOW = 16
POSITION_BITS = 24
HASH_BITS = 39
LAST_POSITION = (1 << POSITION_BITS) - 1
#: Rows in a bucket, at about this number; the number of buckets is bounded.
PER_BUCKET = 2000
BUCKETS = (64, 4096)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use).getItem(0)


def rolled(hashes: Column, reach: int) -> Column:
    """Hashes of twice the length: each with the one ``reach`` places on."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + reach)))


def lesser(keys: Column, reach: int) -> Column:
    return F.transform(keys, lambda x, i: F.least(x, F.get(keys, i + reach)))


def whole(values: Column, length: int) -> Column:
    """Only the places from which ``length`` values follow, one at least."""
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - (length - 1), F.lit(1)))


def select_hashes(text: Column) -> Column:
    """The selected entries of a text, in order of position."""
    units = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), 0)

    def numbered(grams: Column) -> Column:
        return F.transform(
            grams,
            lambda x, i: F.shiftleft(x.bitwiseAND((1 << HASH_BITS) - 1), POSITION_BITS).bitwiseOR(
                (LAST_POSITION - F.least(i, F.lit(LAST_POSITION))).cast("long")
            ),
        )

    def least_of(keys: Column, reach: int) -> Column:
        if reach == WINDOW:
            return F.array_distinct(whole(keys, WINDOW))
        return bind(lesser(keys, reach), lambda m: least_of(m, 2 * reach))

    def grams_of(hashes: Column, reach: int) -> Column:
        if reach == K:
            return bind(numbered(whole(hashes, K)), lambda keys: least_of(keys, 1))
        return bind(rolled(hashes, reach), lambda g: grams_of(g, 2 * reach))

    return bind(F.transform(units, lambda u: F.xxhash64(u)), lambda h: grams_of(h, 1))


def fingerprint_text(selected: Column) -> Column:
    entry = F.transform(
        selected,
        lambda e: F.concat(
            F.lower(F.hex(F.shiftright(e, POSITION_BITS))), F.lit(":"), (LAST_POSITION - e.bitwiseAND(LAST_POSITION)).cast("string")
        ),
    )
    return F.array_join(entry, ",")


def hashes_of(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda e: F.shiftright(e, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1.0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.greatest(union, F.lit(1))).cast("double")


def with_successor_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add ``bucket`` and ``own``: buckets of like size in order of ``doc_id``.

    Each bucket also holds the first row of the next one (of the first, after
    the last), with ``own`` false.  Only ids are read here.
    """
    ids = rows.select("doc_id")
    n = ids.count()
    buckets = min(max(n // PER_BUCKET, BUCKETS[0]), BUCKETS[1])
    fractions = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", fractions, F.lit(20 * buckets))).first()[0] or []))
    places = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(places, lambda c: c <= F.col("doc_id"))), F.lit(0))
    bucketed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    # one row per bucket: bounded by the number of buckets
    first_ids = (
        bucketed.select("bucket", "doc_id")
        .groupBy("bucket")
        .agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null"))
        .collect()
    )
    firsts = sorted((r["bucket"], None if r["has_null"] else r["least"]) for r in first_ids)
    if not firsts:
        return bucketed.withColumn("own", F.lit(True)), buckets
    before = [firsts[k - 1][0] for k in range(len(firsts))]
    keys = rows.sparkSession.createDataFrame([(f[1], b) for f, b in zip(firsts, before, strict=True)], "first_id long, before int")
    guests = (
        rows.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("before", "doc_id")
        .agg(F.min_by("text", F.sha1("text")).alias("text"))
        .select("doc_id", "text", F.col("before").alias("bucket"), F.lit(False).alias("own"))
    )
    return bucketed.withColumn("own", F.lit(True)).unionByName(guests), buckets


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and three likenesses' inputs and results.

    The edited text has the last quarter of the code points replaced by as many
    (or all) of the first of the next document.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt, _ = with_successor_rows(rows)
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), "doc_id", "text_key")
    # texts as a sort key only decide between equal ids
    paired = dealt.withColumn("text_key", F.sha1("text")).select(
        "*", F.lead("text").over(order).alias("next_text"), F.char_length("text").cast("long").alias("n_chars")
    )
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut),
    )
    printed = paired.select("bucket", "own", "doc_id", "text_key", "n_chars", "text", edited.alias("edited")).select(
        "bucket", "own", "doc_id", "text_key", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        select_hashes(F.col("text")).alias("selected"),
        select_hashes(F.col("edited")).alias("edited_selected"),
    )
    return (
        printed.select("*", F.lead("selected").over(order).alias("next_selected"))
        .where("own")
        .select(
            "doc_id", "n_chars", "edited_sha256", "selected", "edited_selected",
            hashes_of(F.col("selected")).alias("hashes"),
            hashes_of(F.col("edited_selected")).alias("edited_hashes"),
            hashes_of(F.col("next_selected")).alias("next_hashes"),
        )
        .select(
            "doc_id", "n_chars", "edited_sha256",
            fingerprint_text(F.col("selected")).alias("fingerprint"),
            fingerprint_text(F.col("edited_selected")).alias("edited_fingerprint"),
            likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
            likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        )
    )
