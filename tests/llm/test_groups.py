"""SimHash groups, fingerprints and line dedup against brute force."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.tables import frame
from trialbook.llm import fingerprints, line_dedup, resemblance, simhash


def expected_fp(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_roots(fps):
    """Smallest reachable position for each fingerprint, over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_every_close_pair_shares_a_key():
    draw = random.Random(1)
    for _ in range(60):
        a = draw.getrandbits(64)
        others = [a ^ 1 << i for i in range(64)] + [a ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(64), 2)]
        keys = simhash.golay_keys(np.array([a, *others], np.uint64).view(np.int64))
        own = set(keys[0].tolist())
        assert keys.shape[1] == 18
        assert all(own & set(k.tolist()) for k in keys[1:])


def test_the_code_is_perfect():
    near = simhash.nearest_codewords()
    assert np.unique(near, return_counts=True)[1].tolist() == [2048] * 4096


def near_fps(seed, centres, each):
    draw, found = random.Random(seed), []
    for _ in range(centres):
        c = draw.getrandbits(64)
        for _ in range(each):
            found.append(c ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))))
            found[-1] &= (1 << 64) - 1
    return sorted(set(found))


def test_components_in_small_and_in_crowded_buckets(spark):
    fps = near_fps(7, 12, 25) + near_fps(8, 1, 400)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = expected_roots(fps)
    want = defaultdict(set)
    for f, r in zip(fps, roots):
        want[r].add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for bucket in (1, 8, 1000):
        got = defaultdict(set)
        for r in simhash.components(simhash.links(table, bucket)).collect():
            got[r["root"]].add(r["fp"] & (1 << 64) - 1)
        assert {frozenset(v) for v in got.values()} == want


def near_texts():
    draw = random.Random(3)
    long = [" ".join(draw.choice("abcdefghijklmnop") * draw.randrange(1, 4) for _ in range(150)) for _ in range(4)]
    texts = [None, "", " \t", "One", "one", "one two", "one two three", "É é", *long, *long]
    for t in long[:2]:
        for k in range(12):
            words = t.split()
            words[k * 5] = "zz"
            texts.append(" ".join(words))
    return texts


def test_rows_and_kept_rows(spark):
    texts = near_texts()
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(95, texts[5]), (None, "lonely words here"), (None, "")]
    docs = frame(spark, rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(0))
    got = simhash.near_groups(docs).collect()
    fps = [expected_fp(t) for _, t in rows]
    roots = expected_roots(fps)
    least = defaultdict(list)
    for (d, _), r in zip(rows, roots):
        least[r].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    want = sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, roots)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(set(roots))
    assert {r["doc_id"] for r in left} == set(least.values())
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def shingles_of(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def first_of_group(texts):
    """For each text the first one of its group, over all pairs."""
    sets = [shingles_of(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def test_similar_texts_group_whatever_their_fingerprints(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = [None, "", "one two", "one two", "one two three"]
    for edits in (60, 9):  # crowds of loose copies, and groups of few
        for _ in range(1 if edits == 60 else 6):
            base = [word() for _ in range(100)]
            for k in range(edits):
                copy = list(base)
                for _ in range(k % 5):
                    copy[draw.randrange(100)] = word()
                texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(80)) for _ in range(40)]
    root = first_of_group(texts)
    docs = frame(spark, list(enumerate(texts)))
    for bucket in (2, 8, 1000):
        kept = simhash.keep_one(docs, bucket, resemblance.SIMILARITY)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert len(set(root)) < simhash.keep_one(docs).count()
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == len(set(root))
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_pages_of_one_template(spark):
    """Pages that share a template and differ by a part of their own, around the threshold."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(90)]
    texts = [" ".join(template[: draw.choice((80, 85, 90))] + [word() for _ in range(draw.randrange(2, 24))]) for _ in range(150)]
    root = first_of_group(texts)
    assert 10 < len(set(root)) < 140
    docs = frame(spark, list(enumerate(texts)))
    for bucket in (2, 16):
        kept = simhash.keep_one(docs, bucket, resemblance.SIMILARITY)
        assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(root))


def test_loose_copies_do_not_meet_at_what_their_crowd_shares(spark):
    """A copy whose own shingles fill the places where a similar pair must meet has none of the base there."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(8))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(600):
        copy = list(base)
        for at in draw.sample(range(4, 140, 6), 1 + k % 8):
            copy[at] = word()
        texts.append(" ".join(copy))
    docs = frame(spark, list(enumerate(texts))).select("doc_id", "text")
    last = resemblance.crowded_last(docs, "text", 0.8, 32)
    signs = resemblance.signed(docs, "text", 0.8, last)
    common = set(resemblance.shingle_set(texts[0].encode()).tolist())
    for r in signs.where("doc_id > 0").collect():
        own = 5 * (1 + (r["doc_id"] - 1) % 8)
        assert not common.intersection(r["shingles"][:own])


def test_near_dedup_meets_by_fingerprints(spark, monkeypatch):
    draw = random.Random(13)
    base = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(1500)]
    texts = [None, "", "one two"]
    for k in range(40):
        texts.append(" ".join("zz" if i == 30 * k else w for i, w in enumerate(base)))
    docs = frame(spark, list(enumerate(texts)))
    signs = {r["doc_id"]: r for r in resemblance.signed(docs.select("doc_id", "text"), "text", 0.8).collect()}
    fps = []
    for i, t in enumerate(texts):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles_of(t)]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        assert signs[i]["fp"] & (1 << 64) - 1 == fps[i]
    # nodes in the order of the texts; the last two have the fingerprint of others
    nodes = spark.createDataFrame([(i, signs[i]["fp"]) for i in range(2, 43)] + [(43, signs[7]["fp"]), (44, signs[2]["fp"])], "node long, fp long")
    roots = expected_roots(fps[2:] + [fps[7], fps[2]])
    for bucket in (2, 32):
        found = simhash.close_nodes(nodes, bucket)
        assert found.where("a >= b").isEmpty()
        got = {r["fp"]: r["root"] for r in simhash.components(found).collect()}
        assert [got.get(i, i) for i in range(2, 45)] == [r + 2 for r in roots]
    assert len(set(roots)) < 30
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, bucket: seen.append(fps.count()) or links(fps, bucket))
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == 3 and seen == [len(set(fps[2:]))]


def test_bands_hold_every_size_that_a_place_allows(spark):
    rows = [(n, p) for n in (1, 2, 3, 7, 20, 101, 1000) for p in range(n) if p <= 0.2 * n]
    banded = resemblance.in_bands(spark.createDataFrame(rows, "n long, pos int"), 0.8)
    listed = {(r["n"], r["pos"], r["other"]) for r in banded.collect()}
    own = {n: b for n, b in spark.range(1, 1300).select("id", resemblance.band(F.col("id"))).collect()}
    for n, p in rows:
        for m in range(1, 1300):
            asked = math.ceil((n + m) * 0.8 / 1.8 - 1e-9)
            if min(n, m) >= 0.8 * max(n, m) and p <= n - asked:
                assert (n, p, own[m]) in listed


def test_different_sets_of_one_node_are_told_apart(spark):
    signs = spark.createDataFrame([(1, 7, 5), (2, 7, 5), (3, 7, 6), (4, 8, 1), (5, 7, 9)], "doc_id int, node long, check long")
    node = {r["doc_id"]: r["node"] for r in resemblance.told_apart(signs).collect()}
    assert node[1] == node[2] == 7 and node[4] == 8 and len(set(node.values())) == 4


# --- fingerprints ----------------------------------------------------------------------


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "")))
    out = []
    for i, (d, t) in enumerate(order):
        t = t or ""
        following = (order[(i + 1) % len(order)][1] or "") if any(x[0] is not None for x in order) else ""
        if not any(x[0] is not None for x in order):
            following = (order[i + 1][1] or "") if i + 1 < len(order) else ""
        third = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcé😀\n ") for _ in range(draw.randrange(40)))
    for rows in (
        [(i * 7 % 101, word()) for i in range(101)] + [(5, "x" * 9), (5, "b" * 9), (None, "null id"), (None, None), (3, None)],
        [(1, "alone in the table")],
        [(2, "abcdef"), (1, None)],
        [(None, "aaa"), (None, "bbb bbb")],
    ):
        got = fingerprints.edited_fingerprints(frame(spark, rows).withColumn("lanes", F.lit("clash")))
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()), key=str) == expected_edits(rows)
    assert fingerprints.edited_fingerprints(frame(spark, [(1, "a")]).limit(0)).count() == 0


def vector(spark, *texts):
    rows = frame(spark, [(1, t) for t in texts])
    found = fingerprints.vectors(rows, ["doc_id"], "text").select(fingerprints.fingerprint("lanes").alias("f"))
    return found.first()["f"]


def test_multiset_laws(spark):
    a, b, c = "first paragraph of it", "second one", "third é"
    whole = vector(spark, "\n".join([a, b, c, b]))
    assert whole == vector(spark, "\n".join([b, c, b, a])) == vector(spark, a, b + "\n" + c, b)
    assert whole != vector(spark, "\n".join([a, b, c]))
    table = spark.createDataFrame([(whole, vector(spark, b))], "x string, y string")
    less = table.select(fingerprints.combined(F.col("x"), F.col("y"), -1).alias("z")).first()["z"]
    assert less == vector(spark, "\n".join([a, b, c]))
    back = table.select(fingerprints.combined(F.lit(less), F.col("y")).alias("z")).first()["z"]
    assert back == whole


def test_likeness(spark):
    draw = random.Random(5)
    text = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    rows = [(2 * i, text()) for i in range(40)]
    rows += [(81, rows[0][1] + " "), (82, rows[1][1]), (83, rows[1][1])]
    found = fingerprints.edited_fingerprints(frame(spark, rows))
    assert not any(k in found._jdf.queryExecution().toString() for k in ("Python", "Pandas", "Arrow"))
    got = {r["doc_id"]: r for r in found.collect()}
    edited = [got[2 * i]["near_edited"] for i in range(40)]
    following = [got[2 * i]["near_next"] for i in range(1, 40)]
    assert 0.4 < min(edited) and max(edited) < 0.9 and max(following) < 0.5
    assert got[83]["near_next"] == 1.0 and got[83]["fingerprint"] == got[82]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


# --- lines -----------------------------------------------------------------------------


def test_boilerplate_lines_go(spark):
    rows = [(i, f"menu\nown line {i}\n\nfooter" if i % 2 else f"other {i}", "big") for i in range(40)]
    rows += [(100 + i, "copied page\nsecond line", "big") for i in range(60)]
    rows += [(200 + i, "menu", None) for i in range(3)] + [(300, None, "big"), (301, "", "big"), (302, "menu\nmenu", "big"), (303, "menu", "small")]
    docs = frame(spark, rows).withColumn("host", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, ratio=0.2, min_pages=4).collect()}
    assert len(got) == len(rows)
    assert got[1]["text"] == "own line 1\n" and (got[1]["n_lines"], got[1]["n_dropped"]) == (4, 2)
    assert got[100]["text"] == "copied page\nsecond line"  # a page counts once however often it is copied
    assert got[200]["text"] == "menu" and got[303]["text"] == "menu"
    assert got[300]["text"] is None and got[300]["n_lines"] == 0
    assert got[301]["text"] == "" and got[302]["text"] == "" and got[302]["n_dropped"] == 2
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_hosts_without_name_are_one_host(spark):
    rows = [(i, f"head\nline {i}", None) for i in range(10)]
    got = line_dedup.drop_boilerplate(frame(spark, rows), min_pages=5).collect()
    assert {r["text"] for r in got} == {f"line {i}" for i in range(10)}


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_host", "_drop", "_stay", "row", "host", "drop", "stay", "n", "dropped", "changed"]
    docs = frame(spark, [(i, f"same line\nown {i}") for i in range(6)]).withColumns({c: F.lit(c) for c in names})
    found = line_dedup.drop_boilerplate(docs, ratio=0.5)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    for r in found.collect():
        assert r["text"] == f"own {r['doc_id']}" and all(r[c] == c for c in names)
