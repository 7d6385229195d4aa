"""Merkle manifest of a dataset: leaves, group roots, one root, and a proof for every row.

A row's leaf is the SHA-256 of its fields. Within a group the leaves stand in the order of a
key, and every ``FANOUT`` consecutive nodes become their parent's digest until one is left,
the group's subroot; the subroots, in the order of the groups, become the root likewise.

The tree is climbed by slot pivots. One pass groups the nodes by the ancestor they share
``DEPTH`` levels up, and conditional aggregates spread them into that ancestor's slot columns
(``FANOUT ** DEPTH`` of them, so no group of rows is larger than that). Concatenating columns
and hashing gives the levels between and the ancestor; the columns of a run without the own
one are a node's siblings. A pass leaves one row in ``FANOUT ** DEPTH``, and the pivots are
written. On the way down the proof of an ancestor meets the pivot row of its descendants, one
join a pass, so a proof is carried once for all rows below it until the last pass.

Positions come from ranges of (group, key): a group that holds most rows is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.operators.ordering import positions
from trialbook.session import pin

FANOUT, DEPTH = 2, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as hashed: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in values.values()])


def _counts(fanout: int, depth: int) -> list[Column]:
    """Nodes of the group at each level of a pass, from its count ``of`` at the lowest."""
    return [F.ceil(F.col("of") / F.lit(fanout**j)) for j in range(depth + 1)]


def _with_levels(pivot: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Adds the nodes of each level of a pass as arrays ``n0`` to ``n<depth>``, null where there
    is none; a group with one node left keeps it as it is."""
    counts, out = _counts(fanout, depth), pivot.withColumn("n0", F.array(*[F.col(f"s{k}.node") for k in range(fanout**depth)]))

    def parents(below: Column, alone: Column, runs: int) -> Column:
        def parent(i: Column) -> Column:
            run = F.slice(below, i * fanout + 1, fanout)
            return F.when(run[0].isNotNull(), F.when(alone, run[0]).otherwise(F.sha2(F.array_join(run, ""), 256)))

        return F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), parent)

    for j in range(1, depth + 1):
        alone, runs = counts[j - 1] <= 1, fanout ** (depth - j)

        def level(below: Column) -> Column:
            return parents(below, alone, runs)

        # the array of one binds the level below, so that it is evaluated once
        bound = F.transform(F.array(f"n{j - 1}"), level)
        out = out.withColumn(f"n{j}", bound[0])
    return out


def climb(nodes: DataFrame, by: list[str], carried: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """The written pivots of all passes, lowest first, and the (by, at, node) that are left.

    ``nodes``: by, at (from 0), of (nodes of the group), node, and columns to carry in the slots
    of the first pass. A group of one node goes through unchanged.
    """
    span = fanout**depth
    most = nodes.agg(F.max("of")).first()[0] or 0
    passes: list[DataFrame] = []
    while True:
        slot = F.col("at") % span
        slots = [F.max(F.when(slot == k, F.struct("node", *carried))).alias(f"s{k}") for k in range(span)]
        keys = [*[F.col(c) for c in by], F.floor(F.col("at") / span).alias("at"), F.col("of")]
        pivot = pin(nodes.groupBy(*keys).agg(*slots))
        passes.append(pivot)
        left = F.col(f"n{depth}")[0].alias("node")
        nodes = _with_levels(pivot, fanout, depth).select(*by, "at", _counts(fanout, depth)[depth].alias("of"), left)
        most, carried = -(-most // span), []
        if most <= 1:
            return passes, nodes.select(*by, "at", "node")


def descend(passes: list[DataFrame], by: list[str], tops: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row for each lowest node: by, its slot's fields, and the other columns of ``tops``
    (one row a group, ``at`` 0), whose ``proof`` is continued downwards.

    ``proof``: an array from the lowest level to the root of (before, after), the digests of the
    run on both sides of the node; both are empty where the node is the only one of its run.
    """
    span, counts = fanout**depth, _counts(fanout, depth)
    rest, rows = [c for c in tops.columns if c not in (*by, "at", "proof")], tops

    def step(level: int) -> Column:
        """The rest of the run of slot ``_k``'s ancestor at a level."""
        i = F.floor(F.col("_k") / F.lit(fanout**level)).cast("int")
        place = i % fanout
        before = F.array_join(F.slice(f"n{level}", i - place + 1, place), "")
        after = F.array_join(F.slice(f"n{level}", i + 2, fanout - 1 - place), "")
        return F.when(counts[level] > 1, F.struct(before.alias("before"), after.alias("after")))

    for pivot in reversed(passes):
        named = rows.withColumnsRenamed({k: f"_of_{k}" for k in [*by, "at"]})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*by, "at"]])
        found = _with_levels(pivot, fanout, depth).join(named, same)
        levels = [f"n{j}" for j in range(depth)]
        slots = F.posexplode(F.array(*[f"s{k}" for k in range(span)])).alias("_k", "slot")
        found = found.select(*by, "at", "of", *levels, *rest, "proof", slots).where(F.col("slot").isNotNull())
        proof = F.concat(F.array_compact(F.array(*[step(j) for j in range(depth)])), F.col("proof"))
        rows = found.select(*by, (F.col("at") * span + F.col("_k")).alias("at"), "slot", *rest, proof.alias("proof"))
        if pivot is not passes[0]:
            rows = rows.drop("slot")
    return rows.select(*by, *rest, "slot.*", "proof")


def fold(node: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, node, lambda have, step: digest(step["before"], have, step["after"]))


def manifest(
    docs: DataFrame,
    claimed: dict[str, Column] | None = None,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """Per row: key, group, leaf, claimed_leaf, subroot, root, proof, folded_root, verified.

    ``claimed`` names fields that a holder states otherwise; claimed_leaf is the leaf of that
    row (null where the statement changes nothing). folded_root follows from the claimed leaf,
    or else the leaf, and the proof; verified tells whether it is the root.

    Null fields are hashed as ``-``; a null group is a group of its own and comes first, as do
    null keys in their group. Rows of one key stand in the order of their leaves; rows equal in
    all fields have equal leaves, each its own place and proof. A lone leaf is its subroot, a
    lone subroot the root. An empty table gives no rows. Columns that are not fields do not
    matter, whatever their names.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    own = leaf(values)
    stated = leaf({**values, **(claimed or {})})
    rows = docs.select(
        F.col(f"`{group}`").alias("group"),
        F.col(f"`{key}`").alias("key"),
        own.alias("node"),
        (F.when(own != stated, stated) if claimed else F.lit(None).cast("string")).alias("claimed"),
        # tells equal rows apart, so that a range of the order never has to hold all of them
        F.monotonically_increasing_id().alias("row"),
    )
    placed = positions(pin(rows), ["group"], ["key", "node", "claimed", "row"], out="place")
    nodes = placed.select("group", "key", "claimed", "node", (F.col("place") - 1).alias("at"), F.col("place_total").alias("of"))
    passes, subroots = climb(nodes, ["group"], ["key", "claimed"], fanout, depth)
    ordered = positions(pin(subroots.drop("at")), [], ["group", "node"], out="place")
    ordered = ordered.select("group", "node", (F.col("place") - 1).alias("at"), F.col("place_total").alias("of"))
    above, root = climb(ordered, [], ["group"], fanout, depth)
    start = root.select("at", F.col("node").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("proof"))
    of_groups = descend(above, [], start, fanout, depth).withColumnRenamed("node", "subroot").withColumn("at", F.lit(0).cast("long"))
    found = descend(passes, ["group"], of_groups, fanout, depth)
    folded = found.withColumn("folded_root", fold(F.coalesce("claimed", "node"), F.col("proof")))
    return folded.select(
        F.col("key").alias(key),
        F.col("group").alias(group),
        F.col("node").alias("leaf"),
        F.col("claimed").alias("claimed_leaf"),
        "subroot",
        "root",
        "proof",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all digests of a proof, lowest level first, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


#: One in so many documents is tampered with.
TAMPERED = 7


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` where documents with a CRC-32 of the id divisible by
    ``TAMPERED`` claim one character more than recorded (a null count stays null)."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    n_chars = F.when(chosen, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    found = manifest(docs, {"n_chars": n_chars})
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified"
    )
