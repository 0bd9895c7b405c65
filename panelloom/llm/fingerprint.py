"""Document fingerprints by order MinHash, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import BLANK

#: Words are cut into units of at most this many characters, so texts without blanks have
#: units too; a k-mer is this many units.
UNIT_CHARS, KMER = 12, 2
#: A signature has 2**BIN_BITS bins, each with a tuple of TUPLE k-mers.
BIN_BITS, TUPLE = 6, 2
#: An element is one number: the high bits of a hash, then the k-mer's place in the text.
PLACE_BITS = 24
_HASH = -(1 << PLACE_BITS)


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _bin_of(x: Column) -> Column:
    """From -2**BIN_BITS / 2 on, in the order of sorted elements."""
    return F.shiftright(x, 64 - BIN_BITS).cast("int")


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_HASH))


def _element(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(_HASH)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(~_HASH)))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` and ``out``, the order-MinHash signature of a text column: one number (bin and
    16 bits of the tuple's hash) per bin, in order of bins; none for a text without elements.

    A k-mer that repeats is numbered by its earlier occurrences, so every occurrence is an
    element of its own.  One hash puts the elements on a ring that is cut into bins; a bin
    takes the TUPLE elements that follow its beginning, its own or else those of the next
    filled bins, puts them in text order and hashes the tuple.  So each bin reads the hash as
    a permutation of its own, rotated to the bin's beginning, and has a whole tuple however
    short the text is (only a text of one element has no order to heed).  A tuple stays
    only if its k-mers and their order stay, so the share of equal tuples falls with edit
    distance and not only with the set of k-mers.  Null and blank texts have no elements.
    """
    u, h, s, r, b, e, k, f = (f"_{out}_{x}" for x in ("units", "hashes", "sorted", "repeats", "runs", "elements", "least", "filled"))
    at = lambda name, i: F.get(F.col(name), i)
    d = df.withColumn(u, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^{BLANK}]{{1,{UNIT_CHARS}}}"), F.lit(0)))
    starts = F.sequence(F.lit(0), F.greatest(F.size(u) - KMER, F.lit(0)))
    hashed = F.transform(starts, lambda i: _element(F.xxhash64(*[at(u, i + j) for j in range(KMER)]), i))
    d = d.withColumn(h, F.when(F.size(u) > 0, hashed).otherwise(F.array().cast("array<bigint>"))).drop(u)
    d = d.withColumn(s, F.sort_array(h)).drop(h)
    same = lambda name, x, i: (i > 0) & (_hash_of(at(name, i - 1)) == _hash_of(x))
    d = d.withColumn(r, F.filter(s, lambda x, i: same(s, x, i)))
    # Among the repeats of each k-mer, number the occurrences and hash the number in.
    places = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (_hash_of(at(r, i - 1)) != _hash_of(at(r, i))))
    d = d.withColumn(b, F.when(F.size(r) > 0, places).otherwise(F.array().cast("array<int>")))
    numbered = F.flatten(F.transform(b, lambda start, j: F.transform(
        F.slice(F.col(r), start + 1, F.coalesce(at(b, j + 1), F.size(r)) - start), lambda x, n: _element(F.xxhash64(_hash_of(x), n + 1), _place_of(x)),
    )))
    firsts = F.filter(s, lambda x, i: ~same(s, x, i))
    d = d.withColumn(e, F.when(F.size(r) > 0, F.sort_array(F.concat(firsts, numbered))).otherwise(F.col(s))).drop(s, r, b)
    d = d.withColumn(k, F.filter(e, lambda x, i: (i < TUPLE) | (_bin_of(at(e, F.greatest(i - TUPLE, F.lit(0)))) != _bin_of(x)))).drop(e)
    filled = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: (i == 0) | (_bin_of(at(k, i - 1)) != _bin_of(at(k, i))))
    d = d.withColumn(f, F.when(F.size(k) > 0, filled).otherwise(F.array().cast("array<int>")))
    return d.withColumn(out, _tuples(k, f)).drop(k, f)


def _tuples(k: str, f: str) -> Column:
    """One number per bin from the least elements of the filled bins (sorted, so bins are
    runs) and the places where these runs begin."""
    at = lambda i: F.get(F.col(k), i)
    half = 1 << (BIN_BITS - 1)

    def tuple_of(i: Column) -> Column:
        one, two = at(i), at((i + 1) % F.size(k))
        pair = F.when(_place_of(one) < _place_of(two), F.xxhash64(_hash_of(one), _hash_of(two))).otherwise(F.xxhash64(_hash_of(two), _hash_of(one)))
        hashed = F.when(F.size(k) == 1, F.xxhash64(_hash_of(one))).otherwise(pair)
        return hashed.bitwiseAND(F.lit(0xFFFF)).cast("int")

    # Empty bins take the tuple of the next filled one; those after the last, of the first.
    before = lambda j: F.coalesce(_bin_of(at(F.get(F.col(f), j - 1))), F.lit(-half - 1))
    up_to_last = F.flatten(F.transform(f, lambda i, j: F.array_repeat(tuple_of(i), _bin_of(at(i)) - before(j))))
    after_last = F.array_repeat(tuple_of(F.lit(0)), half - 1 - _bin_of(at(F.size(k) - 1)))
    numbered = F.transform(F.concat(up_to_last, after_last), lambda x, n: F.shiftleft(n, 16).bitwiseOR(x))
    return F.when(F.size(k) > 0, numbered).otherwise(F.array().cast("array<int>"))


def as_text(signature: str) -> Column:
    """A signature as a string: six hexadecimal digits per bin."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the bins that either signature fills; 1 for two empty ones."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 16)), F.transform(b, lambda x: F.shiftright(x, 16))))
    return F.when(bins > 0, F.size(F.array_intersect(a, b)) / bins).otherwise(F.lit(1.0))


def _block(doc_id: Column, bounds: list[int]) -> tuple[Column, Column]:
    """How many of the sorted bounds an id reaches, and the last it reaches: looked up among
    every n-th bound first, then in that stretch."""
    if not bounds:
        return F.lit(0), F.lit(None).cast("long")
    n = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + n] for i in range(0, len(bounds), n)]
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    part = F.size(F.filter(array([p[0] for p in parts]), lambda x: x <= doc_id))
    own = F.get(F.array(*[array(p) for p in parts]), part - 1)
    reached = F.when(doc_id.isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * n + F.size(F.filter(own, lambda x: x <= doc_id)))
    return reached, F.get(own, reached - (part - 1) * n - 1)


def with_next(docs: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """Rows (``block``, ``guest``, ``doc_id``, ``text``) dealt to blocks of neighbouring ids.

    Each block also gets the first rows of the next one as guests, and the last block those
    of the very first, so the row after any other is in its block: ascending ids, null
    first, rows with one id by text.  The texts are shuffled once; the ids that begin blocks
    are quantiles.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    blocks = max(1, min(100_000, ids.n // block_rows, ids.n))
    bounds: list[int] = []
    if blocks > 1:
        at = [i / blocks for i in range(1, blocks)]
        found = docs.agg(F.percentile_approx("doc_id", F.lit(at), F.lit(max(10_000, 10 * blocks))).alias("q")).first().q
        bounds = sorted({int(x) for x in found} - {ids.least})
    block, reached = _block(F.col("doc_id"), bounds)
    least = F.col("doc_id").isNull() if ids.nulls else F.col("doc_id") == F.lit(ids.least)
    before = F.when(least, F.lit(len(bounds))).when(F.col("doc_id") == reached, block - 1)
    own = F.struct(block.alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(before.cast("int").alias("block"), F.lit(True).alias("guest"))
    rows = docs.select("doc_id", "text", F.explode(F.when(before.isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    return rows.select("to.block", "to.guest", "doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of ``docs`` (``doc_id`` a whole number, ``text``) and an
    edited form, whose last half is replaced by as much of the next document's beginning.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, one row per input row.  A null
    text counts as empty: its fingerprint is the empty string, like any blank text's, and
    two such texts have likeness 1.  Equal texts have equal fingerprints.  Rows that repeat
    an id follow one another by text; a null id comes first; a single row is its own next;
    other columns are ignored; an empty table gives no rows.
    """
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    d = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    d = with_signature(d.withColumn("edited", F.coalesce(edited, F.lit(""))), "text", "own")
    d = d.withColumn("next", F.lead("own").over(Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))))
    d = with_signature(d.where("not guest").drop("text", "next_text"), "edited", "changed")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
