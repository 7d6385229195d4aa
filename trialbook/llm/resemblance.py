"""Documents whose word shingles have a Jaccard similarity of at least a threshold.

A text's set holds the XXH64 of its five-word shingles. The first candidates are sets whose
SimHash fingerprints meet on Golay keys and differ in at most two bits, as in ``simhash``. At this
similarity most pairs differ in more, so prefixes lead to the others: with all shingles in one order, two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each, n the set's own size. So no pair is missed, whatever the order. The
order is by hash, with crowded shingles (common lines and passages) moved to the end, the most
crowded last: what a near copy has of its own comes before what its crowd shares, so one that
shares too little with its crowd does not meet it. Candidates are verified with the whole sets.

Members of a key over ``BUCKET`` sets, which a large group of near copies makes, first meet
``LEADERS`` of them: the one with the most crowded prefix, and some by hash. Of the members, only those that are
then not in the key's largest component meet others of the key that are in another component.
That leaves the components of all pairs. Two sets that share enough for their sizes n and m share
a shingle among the first n - s + 1 and m - s + 1, s = ceil((n + m) t / (1 + t)); so a shingle's
place in a prefix bounds the sizes of the sets it has to lead to. Members outside the largest
component meet in bands of size (``STEP``) that these bounds allow: pages of one template that share
clearly less than the threshold asks never meet, and the rest is ruled out by 1024 parity bits.

A set's name has 128 bits, of which 64 serve as its node: ``told_apart`` gives different sets of
one node nodes of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices
from trialbook.llm.components import components
from trialbook.operators.attach import attach
from trialbook.session import pin, scratch

WORDS, SEED = 5, 42
SIMILARITY = 0.8
BUCKET, LEADERS = 32, 4
#: Ratio of the largest to the smallest size in a band.
STEP = 1.05
#: Crowded shingles moved to the end, the most crowded first; twelve bytes each.
MOVED = 1_000_000
#: Crowded shingles are looked for in one of so many texts.
PART = 8
PARITIES = [f"p{k}" for k in range(16)]


def shingle_set(data: bytes | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The different shingle hashes in order; words as in ``simhash.fingerprints``."""
    parts = data.lower().split() if data else []
    if not parts:
        return np.empty(0, np.int64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), np.uint64).view(np.int64))


def prefix(shingles: np.ndarray, similarity: float, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set; those in ``last`` (in order) come after all others, by ``rank``."""
    n = len(shingles)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if len(last) and n:
        at = np.minimum(np.searchsorted(last, shingles), len(last) - 1)
        moved = last[at] == shingles
        shingles = np.concatenate([shingles[~moved], shingles[moved][np.argsort(rank[at[moved]])]])
    return shingles[:size]


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set: a bit is set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        some = shingles[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def parities(shingles: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the hashes that fall on it. Two sets differ in at least as
    many shingles as these in bits."""
    odd = np.bincount(shingles & 1023, minlength=1024).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def signed(docs: DataFrame, text: str, similarity: float, last=None, whole: bool = False) -> DataFrame:
    """``docs`` without ``text``, with node and check (two hashes of the set), n, its parities and
    the prefix or whole set; with the prefix also fp, the set's fingerprint."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(text).cast("binary").alias("_text"), *rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])

    def run(batches):
        behind = last.value if last else (np.empty(0, np.int64), np.empty(0, np.int32))
        for batch in slices(batches):
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            names = [np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED + k) for s in sets), np.uint64, len(sets)) for k in (0, 1)]
            kept = sets if whole else [prefix(s, similarity, *behind) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    *(pa.array(name.view(np.int64)) for name in names),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(column) for column in np.stack([parities(s) for s in sets], 1)),
                    pa.array(kept, pa.list_(pa.int64())),
                    *([] if whole else [pa.array([fingerprint(s) for s in sets], pa.int64())]),
                ],
                names=[*batch.schema.names[1:], "node", "check", "n", *PARITIES, "shingles", *([] if whole else ["fp"])],
            )

    return rows.mapInArrow(run, (f"{fields}, " if fields else "") + "node long, check long, n long, " + "".join(f"{b} long, " for b in PARITIES) + "shingles array<long>" + ("" if whole else ", fp long"))


def text_name(text: str) -> Column:
    """128 bits that name a text; none for a null."""
    return F.coalesce(F.unhex(F.md5(F.col(text))), F.lit(bytearray()))


def told_apart(signs: DataFrame) -> DataFrame:
    """``signs`` without check: of different sets of one node, all but that with the least check
    get another node."""
    several = signs.groupBy("node").agg(F.min("check").alias("_least"), F.max("check").alias("_most")).where("_least < _most")
    found = attach(signs, several.select("node", "_least"), ["node"])
    other = F.when(F.col("check") > F.col("_least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return found.withColumn("node", other).drop("check", "_least")


def band(size: Column) -> Column:
    """The number of the band a size of at least 0.5 falls in."""
    return F.floor(F.log(size) / math.log(STEP)).cast("int")


def in_bands(members: DataFrame, similarity: float) -> DataFrame:
    """``members`` (key, node, n, pos and others) once for each band ``other`` of the sizes to
    which the shingle at ``pos`` has to lead; ``own``: the band of n."""
    most = F.least(F.col("n") / similarity, (F.col("n") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("n")) + 1e-6
    least = F.col("n") * similarity - 1e-6
    rows = members.where(most >= least)
    return rows.select("*", band(F.col("n")).alias("own"), F.explode(F.sequence(band(least), band(most))).alias("other"))


def crowded_last(docs: DataFrame, text: str, similarity: float, bucket: int):
    """A broadcast of the shingles to put last, in order, and their ranks, the most crowded last.
    They are counted in a part of the texts, as any list leaves the result whole; it only decides
    how many candidates there are."""
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(PART)) == 0).select(text)
    least = max(2, bucket // PART)
    spark = docs.sparkSession
    with scratch(spark):
        keys = signed(some, text, similarity, whole=True).select(F.explode("shingles").alias("key"))
        counts = pin(keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > least))
        found = counts.orderBy(F.col("c").desc(), "key").limit(MOVED).select("key").toPandas()["key"].to_numpy(np.int64)
    order = np.argsort(found)
    return spark.sparkContext.broadcast((found[order], (len(found) - order).astype(np.int32)))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Many b may come with one a."""
    b = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
    own = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = attach(b, own.join(pairs.select("a").distinct(), "a", "left_semi"), ["a"], "inner")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.col("na") + F.col("nb") - shared) >= similarity).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, text: str, similarity: float, bucket: int, meet: Callable) -> DataFrame:
    """Links (a, b) between nodes, enough for the components of all similar pairs. ``nodes``:
    node, n, parities, shingles (the prefix), fp and text_hash of every different set; ``meet``:
    the pairs (a, b) of nodes whose fingerprints are close. Sets without shingles have no keys and
    are linked by nothing but their equal node; no nodes, no links."""
    with scratch(docs.sparkSession) as keep:
        close = keep(meet(nodes.where("n > 0").select("node", "fp"), bucket))
    keys = nodes.select("node", "n", F.posexplode("shingles").alias("pos", "key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = pin(attach(keys, pin(sizes), ["key"], "inner"))

    def sides(x: DataFrame, y: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
        """Pairs that meet at a key and whose sizes allow the similarity."""
        x, y = (t.withColumnsRenamed({c: f"{c}{s}" for c in ("node", "n", "pos")}) for t, s in ((x, "a"), (y, "b")))
        met = x.join(y, list(on)).where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
        return met.withColumnsRenamed({"nodea": "a", "nodeb": "b"})

    # whether a similar pair of these sizes may have its first shared shingle at these places
    begun = (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) <= F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) + 1e-6

    def possible(pairs: DataFrame, about: DataFrame, also: Column) -> DataFrame:
        """The pairs whose parities allow the similarity; parities come to different pairs only."""
        for side in "ab":
            pairs = pairs.join(about.withColumnsRenamed({"node": side, **{x: f"{x}{side}" for x in about.columns[1:]}}), side)
        apart = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in PARITIES), F.lit(0))
        near = apart <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9
        return pairs.where(near & also).select("a", "b")

    about = nodes.select("node", "n", *PARITIES)
    small = shared.where(F.col("c") <= bucket).select("key", "node", "n", "pos")
    many = pin(shared.where(F.col("c") > bucket).select("key", "node", "n", "pos"))
    # what two prefixes share and what lies behind the one that ends first bound what the sets share
    pairs = sides(small, small).where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"), F.max(begun).alias("begun")).where("begun")
    held = many.groupBy("node").agg(F.count("*").alias("k"))
    ends = about.join(held, "node", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    most = F.col("met") + F.least("ka", "kb") + F.ceil(similarity * F.greatest("na", "nb") - 1e-9) - 1
    enough = most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = possible(pairs, ends, enough)
    # the larger the crowded share of a prefix, the nearer a set is to the middle of its crowd
    share = many.groupBy("node").agg((-F.count("*") / F.min("n")).alias("s"))
    orders = [F.col("s"), *(F.xxhash64(F.lit(k), "node") for k in range(1, LEADERS))]
    firsts = [F.min(F.struct(o.alias("o"), "node", "n")) for o in orders]
    heads = attach(many, share, ["node"], "inner").groupBy("key").agg(F.array_distinct(F.array(*[f.dropFields("o") for f in firsts])).alias("of"))
    heads = pin(heads.select("key", F.inline("of")))
    star = sides(heads, many.drop("pos")).where("a <> b").select("a", "b").distinct()
    met = star.unionByName(close).distinct()
    pairs = pin(pairs.unionByName(possible(met, about, F.lit(True))).distinct())

    def with_sets(found: DataFrame) -> DataFrame:
        """The links among ``found``: whole sets are made of one text of each node in it."""
        met = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        of = nodes.select("node", "text_hash").join(met, "node", "left_semi").withColumnRenamed("node", "known")
        texts = attach(docs.select(text, text_name(text).alias("text_hash")), of, ["text_hash"], "inner")
        sets = signed(texts.dropDuplicates(["text_hash"]).select(text, "known"), text, similarity, whole=True)
        sets = pin(sets.select(F.col("known").alias("node"), "n", "shingles"))
        return pin(verified(found, sets, similarity))

    sure = with_sets(pairs)
    if many.isEmpty():
        return sure
    labels = components(sure).withColumnsRenamed({"fp": "node"})
    many = pin(attach(many, labels, ["node"]).withColumn("root", F.coalesce("root", "node")))
    mains = many.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    rest = pin(attach(many, mains, ["key"], "inner").where("root <> main").select("key", "node", "n", "pos", "root"))
    if rest.isEmpty():
        return sure
    near = in_bands(attach(many, rest.select("key").distinct(), ["key"], "left_semi"), similarity)
    near = near.select("key", "node", "n", "pos", F.col("root").alias("beside"), F.col("own").alias("other"), F.col("other").alias("own"))
    others = sides(in_bands(rest, similarity), near, ("key", "own", "other")).where(begun & (F.col("root") != F.col("beside")))
    others = others.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return sure.unionByName(with_sets(pin(possible(others.distinct(), about, F.lit(True)))))


def grouped(docs: DataFrame, key: str, text: str, meet: Callable, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Per row: key, text_hash, node, root: the smallest node of the component. ``meet``: as in ``links``."""
    last = crowded_last(docs, text, similarity, bucket)
    with scratch(docs.sparkSession) as keep:
        signs = told_apart(pin(signed(docs.select(key, text, text_name(text).alias("text_hash")), text, similarity, last)))
        nodes = keep(signs.select("node", "n", *PARITIES, "shingles", "fp", "text_hash").dropDuplicates(["node"]))
        rows = keep(signs.select(key, "text_hash", "node"))
    with scratch(docs.sparkSession) as keep:
        found = keep(links(docs, nodes, text, similarity, bucket, meet))
    roots = components(found)
    return attach(rows, roots.withColumnRenamed("fp", "node"), ["node"]).withColumn("root", F.coalesce("root", "node"))
