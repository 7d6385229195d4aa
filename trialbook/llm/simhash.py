"""SimHash near-duplicates with Golay-code keys.

Fingerprints are 64 bits in three segments of 22, 21 and 21 bits. Each segment, filled up
to 23 bits, lies within distance 3 of exactly one word of the perfect binary Golay code, and
the code words next to it (of itself and of its one-bit neighbours) number six at most. Two
segments that differ in two bits or fewer share one of these. If two fingerprints differ in
two bits or fewer, one of the three segments is equal (pigeonhole) and the next one differs
in at most two; so (equal segment, code word near the next one) is a key they share.

Fingerprints meet on these keys and are verified bit by bit. In a bucket over ``BUCKET``
members, which a large group of near copies makes, pairs are not formed: every member lists
itself and its 64 one-bit neighbours as meeting points instead, and two fingerprints are
linked exactly if they share a point (at most 65 members a point). That way is as exact as
the pairs and linear in the members.

Components come from repeated passing of the smallest label along links, with the labels'
own labels followed in each round; each round is written to the shared folder.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.llm import resemblance
from trialbook.llm.arrow import slices
from trialbook.llm.components import components
from trialbook.operators.attach import attach
from trialbook.session import pin, scratch

WIDTHS = (22, 21, 21)
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 makes the code.
GENERATOR = 0b101011100011
MAX_DISTANCE = 2
BUCKET = 32
WORDS, SEED = 3, 42


def _fingerprint(data: bytes | None, words: int, seed: int) -> int:
    parts = data.lower().split() if data else []
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):
        some = parts[at : min(at + (1 << 14), n) + words - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
        hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` without ``text``, with ``fp``: the 64 bits as a long.

    Words are split at ASCII white space and lower-cased in A-Z; shingles count as often as
    they occur; a bit is set if over half of the shingles' XXH64 have it. Fewer words than a
    shingle needs: the whole sequence. No words or null text: zero.
    """
    rest = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(F.col(text).cast("binary").alias("fp"), *rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])

    def run(batches):
        for batch in slices(batches):
            found = [_fingerprint(t, words, seed) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *batch.columns[1:]], names=batch.schema.names)

    return rows.mapInArrow(run, "fp long" + (f", {fields}" if fields else ""))


@lru_cache(maxsize=1)
def nearest_codewords() -> np.ndarray:
    """For each 23-bit word the index of the code word within distance 3."""
    low = np.arange(1 << 11, dtype=np.int64)

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
        return x

    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[i + 1 :]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1 :], i + 1) for c in ones[j + 1 :]]
    errors = np.array(errors, dtype=np.int64)
    leader = np.empty_like(low)
    leader[remainder(errors)] = errors
    near = np.empty(1 << 23, np.uint16)
    for at in range(0, 1 << 23, 1 << 19):
        some = np.arange(at, at + (1 << 19), dtype=np.int64)
        near[at : at + (1 << 19)] = (some ^ leader[remainder(some)]) >> 11
    return near


def golay_keys(fps: np.ndarray) -> np.ndarray:
    """18 keys for each fingerprint, in rows; repeated where a segment has one code word."""
    near, u = nearest_codewords(), fps.astype(np.int64).view(np.uint64)
    segments, at = [], 0
    for width in WIDTHS:
        segments.append((u >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1))
        at += width
    keys = []
    for i in range(3):
        other = segments[(i + 1) % 3]
        words = np.stack([near[other], *(near[other ^ (1 << b)] for b in range(23))], 1)
        words.sort(axis=1)
        new = np.concatenate([np.ones((len(other), 1), bool), words[:, 1:] != words[:, :-1]], 1)
        place = np.cumsum(new, 1) - 1
        six = np.repeat(words[:, :1], 6, 1)
        row = np.nonzero(new)[0]
        six[row, place[new]] = words[new]
        keys.append((np.int64(i) << 34 | segments[i][:, None] << 12) | six.astype(np.int64))
    return np.concatenate(keys, 1)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp), one row for each different key of a fingerprint."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1 << 14):
                part = fp[at : at + (1 << 14)]
                keys = np.sort(golay_keys(part), 1)
                new = np.concatenate([np.ones((len(part), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)
                row = np.nonzero(new)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(part[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints, enough of them for the components of all
    pairs within two bits. ``fps``: different fingerprints in a column ``fp``."""
    keys = pin(keyed(fps))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = pin(keys.join(sizes, "key"))
    small = shared.where(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    points = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # at most 65 fingerprints meet at a point
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    met = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(met.select("a", "b")).distinct()


def close_nodes(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, whose fingerprints are equal or linked by ``links``: enough for
    the components of all nodes within two bits. ``nodes``: different nodes with their fp."""
    first = pin(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = attach(nodes.select("node", "fp"), first, ["fp"], "inner").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = links(first.select("fp"), bucket)
    for side in "ab":
        met = met.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}")), side)
    met = met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return equal.where("a < b").unionByName(met)


def grouped(docs: DataFrame, key: str, text: str, bucket: int) -> DataFrame:
    """Per row: key, text_hash, fp, root: the smallest fingerprint of the component."""
    rows = pin(fingerprints(docs.select(key, text, F.xxhash64(text).alias("text_hash")), text))
    nodes = pin(rows.select("fp").distinct())
    roots = components(links(nodes, bucket))
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return attach(rows, rooted, ["fp"], "inner")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id.

    component_id: the smallest key whose fingerprint can be reached over fingerprints that
    differ in at most two bits; equal fingerprints are one node, so copies never make pairs.
    Null keys get the component of their fingerprint; it is null where no member has a key.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = pin(grouped(docs, key, text, bucket))
    least = rows.groupBy("root").agg(F.min(key).alias("component_id"))
    return attach(rows, least, ["root"], "inner").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that with the smallest
    doc_id. Groups are those of ``near_groups``, or with ``similarity`` those of five-word
    shingle sets whose Jaccard similarity is at least that (``resemblance``). A row without doc_id stays only if no row of its group has one; of rows equal in
    doc_id and text one stays. An empty table gives no rows."""
    # one shuffle of the texts serves the choice and the removal of repeated rows
    place = ["_id", "_none", "_hash"]

    def placed(ident, hashed) -> list:
        return [F.coalesce(ident.cast("string"), F.lit("")).alias("_id"), ident.isNull().alias("_none"), hashed.alias("_hash")]

    with scratch(docs.sparkSession) as keep:
        if similarity is None:
            rows, named = grouped(docs, "doc_id", "text", bucket), F.xxhash64("text")
        else:
            rows, named = resemblance.grouped(docs, "doc_id", "text", close_nodes, similarity, bucket), resemblance.text_name("text")
        first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "text_hash")).alias("k"))
        kept = keep(first.select(*placed(F.col("k.doc_id"), F.col("k.text_hash"))).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = docs.select(*placed(F.col("doc_id"), named), row).join(kept, place, "left_semi")
    return found.groupBy(*place).agg(F.first("_row").alias("_row")).select("_row.*")
