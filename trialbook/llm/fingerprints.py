"""Homomorphic multiset fingerprints of documents, in DataFrame expressions only.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane, modulo powers of two. So the order of paragraphs
does not matter, a paragraph is added or taken away by adding or subtracting its vector, and
equal multisets have equal fingerprints. A vector has

* ``LANES`` lanes of 32 bits, each another hash of the whole paragraph: they tell multisets
  apart;
* 62 lanes of 31 bits that count, over the paragraph's three-word shingles, how often each
  bit of the shingle's hash is set, and one lane with the number of shingles. Twice the count
  less the number is a random projection of the shingle counts, so the distance of two
  fingerprints estimates what two documents do not share.

Two counting lanes lie in one long, 31 bits apart; a text would need 2^31 words to carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 16
PAIRS = 31
WORDS = 3
LOW32 = (1 << 32) - 1
LOW31 = (1 << 31) - 1


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``lanes``: the sums over each group's texts, as an array of the identity
    lanes, the number of shingles and the paired counting lanes.

    Rows with the same keys are summed, so a text may come in any number of parts that end
    at paragraph borders. Null text counts as empty.
    """
    split = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    paragraphs = rows.select(*keys, split.alias("_p"))
    shingle = "xxhash64(x" + "".join(f", get(ws, i + {k})" for k in range(1, WORDS)) + ")"
    starts = f"slice(ws, 1, greatest(size(ws) - {WORDS - 1}, 1))"
    hashes = F.expr(f"element_at(transform(array(split(_p, ' ', -1)), ws -> transform({starts}, (x, i) -> {shingle})), 1)")
    paragraphs = paragraphs.select(
        *keys, F.xxhash64("_p").alias("_a"), F.xxhash64(F.lit(LANES), F.col("_p")).alias("_b"), hashes.alias("_hashes")
    )
    units = paragraphs.select(*keys, "_a", "_b", F.posexplode("_hashes").alias("_at", "_h"))
    # the paragraph itself is counted with its first shingle
    identity = [F.expr(f"sum(if(_at = 0, xxhash64({i}, _a, _b) & {LOW32}L, 0L)) AS e{i}") for i in range(LANES)]
    counts = [F.expr(f"sum(shiftrightunsigned(_h, {i}) & {1 | 1 << PAIRS}L) AS c{i}") for i in range(PAIRS)]
    summed = units.groupBy(*keys).agg(*identity, F.count("*").alias("n"), *counts)
    lanes = ", ".join([*(f"e{i} & {LOW32}L" for i in range(LANES)), "n", *(f"c{i}" for i in range(PAIRS))])
    return summed.select(*keys, F.expr(f"array({lanes})").alias("lanes"))


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def _counting(lanes: Column) -> Column:
    """The 62 counting lanes of a vector, the lower of each pair first."""
    pairs = F.slice(lanes, LANES + 2, PAIRS)
    low = F.transform(pairs, lambda c: c.bitwiseAND(F.lit(LOW31)))
    return F.concat(low, F.transform(pairs, lambda c: F.shiftrightunsigned(c, PAIRS).bitwiseAND(F.lit(LOW31))))


def fingerprint(lanes: str) -> Column:
    """A vector as one hex text: 8 digits for each lane."""
    own = F.slice(F.col(lanes), 1, LANES + 1)
    return F.array_join(F.transform(F.concat(own, _counting(F.col(lanes))), _hex), "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together, or with ``sign`` -1 of a without b."""
    size = LANES + 1 + 2 * PAIRS

    def lane(k: Column) -> Column:
        low = F.when(k < LANES, F.lit(LOW32)).otherwise(F.lit(LOW31))
        x, y = (F.conv(F.substring(v, k * 8 + 1, F.lit(8)), 16, 10).cast("long") for v in (a, b))
        return _hex((x + sign * y).bitwiseAND(low))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lane), "")


def likeness(a: str, b: str) -> Column:
    """How much two documents share, 0 to 1, from their vectors: 1 if all lanes are equal,
    else one less the estimated distance of the shingle counts, relative to both sizes, and
    below 1. A null vector is like nothing."""

    def signed(lanes: str) -> Column:
        n = F.element_at(F.col(lanes), LANES + 1)
        return F.transform(_counting(F.col(lanes)), lambda c: (2 * c - n).cast("double"))

    both = F.zip_with(signed(a), signed(b), lambda x, y: F.struct((x * y).alias("xy"), (x * x + y * y).alias("xx")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))
    sums = F.aggregate(both, zero, lambda s, v: F.struct((s["xy"] + v["xy"]).alias("xy"), (s["xx"] + v["xx"]).alias("xx")))
    near = F.element_at(F.transform(F.array(sums), lambda s: F.when(s["xx"] > 0, 2 * s["xy"] / s["xx"])), 1)
    near = F.least(F.greatest(F.coalesce(near, F.lit(0.0)), F.lit(0.0)), F.lit(0.999999))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(near)


def chunk_borders(docs: DataFrame, key: str, chunks: int) -> list:
    """Ids that begin a chunk in descending order: quantiles of the ids, and the largest."""
    found = docs.agg(
        F.percentile_approx(key, [k / chunks for k in range(1, chunks)], 10 * chunks).alias("q"), F.max(key).alias("m")
    ).first()
    return sorted({*(found["q"] or []), *([] if found["m"] is None else [found["m"]])}, reverse=True)


def in_chunks(docs: DataFrame, key: str, chunks: int) -> DataFrame:
    """``docs`` dealt into ranges of descending ``key``, with ``_chunk`` and ``_copy``.

    The rows that begin a chunk are also handed to the chunk before it (``_copy`` 1; for the
    first chunk that is the last one, round the end), so that in each chunk, ordered by _copy and
    descending key, every row's successor is the next row. A null key goes to the end. The
    number of chunks is the number of borders at most, a parameter of the session's size.
    """
    borders = chunk_borders(docs, key, max(2, chunks))
    if not borders:
        return docs.withColumns({"_chunk": F.lit(0), "_copy": F.lit(0)})
    last = len(borders) - 1
    wide = max(1, int(len(borders) ** 0.5))
    groups = [borders[i : i + wide] for i in range(0, len(borders), wide)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*map(F.lit, g)) for g in groups])

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b >= F.col(key)))

    # how many borders are at or above the key: first by groups of borders, then in the group
    group = F.when(F.col(key).isNull(), F.lit(len(groups))).otherwise(upto(heads))
    inside = F.when(F.col(key).isNull(), F.lit(len(groups[-1]))).otherwise(upto(F.element_at(table, group)))
    rows = docs.withColumn("_group", group).withColumn("_chunk", (F.col("_group") - 1) * wide + F.when(F.col(key).isNull(), F.lit(len(groups[-1]))).otherwise(inside) - 1)
    begins = F.element_at(F.element_at(table, F.col("_group")), F.col("_chunk") - (F.col("_group") - 1) * wide + 1) == F.col(key)
    before = F.when(F.col("_chunk") == 0, F.lit(last)).otherwise(F.col("_chunk") - 1)
    own = F.struct(F.col("_chunk").alias("_chunk"), F.lit(0).alias("_copy"))
    copy = F.struct(before.alias("_chunk"), F.lit(1).alias("_copy"))
    places = F.when(F.coalesce(begins, F.lit(False)), F.array(own, copy)).otherwise(F.array(own))
    rows = rows.withColumn("_place", F.explode(places)).drop("_group", "_chunk")
    return rows.select("*", "_place._chunk", "_place._copy").drop("_place")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has the last third (rounded down, in code points) replaced by the first
    as many of the next document in descending key, round the end. Null text counts as empty.
    Rows with equal keys follow each other by text; null keys come last; a table whose keys
    are all null has no order and its last row no next document (empty). Repeated rows stay
    repeated; an empty table gives no rows; other columns are not read. Texts are shuffled
    once, by ranges of the key; everything after it happens where they lie.
    """
    chunks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = in_chunks(rows, "_id", chunks)
    order = Window.partitionBy("_chunk").orderBy("_copy", F.col("_id").desc_nulls_last(), "_text")
    rows = rows.select(
        "_chunk", "_copy", "_id", "_text", F.lead("_text").over(order).alias("_next"), F.row_number().over(order).alias("_row")
    )
    n = F.length("_text")
    third = (n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    rows = rows.select("_chunk", "_row", "_copy", "_id", n.alias("_n"), "_text", edited.alias("_edited"))
    two = F.array(
        F.struct(F.lit(0).alias("_kind"), F.col("_text").alias("_text"), F.lit("").alias("_sha")),
        F.struct(F.lit(1).alias("_kind"), F.col("_edited").alias("_text"), F.sha2("_edited", 256).alias("_sha")),
    )
    rows = rows.select("_chunk", "_row", "_copy", "_id", "_n", F.explode(two).alias("_t"))
    keys = ["_chunk", "_row", "_copy", "_id", "_n", "_kind", "_sha"]
    summed = vectors(rows.select("_chunk", "_row", "_copy", "_id", "_n", "_t.*"), keys, "_text")
    # one row per document again; all of it keeps the dealing by chunk
    pairs = summed.groupBy("_chunk", "_row", "_copy", "_id", "_n").agg(
        F.max("_sha").alias("edited_sha256"),
        F.first(F.when(F.col("_kind") == 0, F.col("lanes")), ignorenulls=True).alias("_own"),
        F.first(F.when(F.col("_kind") == 1, F.col("lanes")), ignorenulls=True).alias("_changed"),
    )
    follow = Window.partitionBy("_chunk").orderBy("_row")
    pairs = pairs.withColumn("_following", F.lead("_own").over(follow)).where("_copy = 0")
    return pairs.select(
        F.col("_id").alias(key),
        F.col("_n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint("_own").alias("fingerprint"),
        fingerprint("_changed").alias("edited_fingerprint"),
        likeness("_own", "_changed").alias("near_edited"),
        likeness("_own", "_following").alias("near_next"),
    )
