"""Merkle manifest, licence scan and collocations against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import frame
from trialbook.llm import collocations, licenses, merkle, queries
from trialbook.plans import check

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""

    def leaf(r, more=0):
        values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([H("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
        return levels

    def proof(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            run = level[first : first + fanout]
            out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
            i //= fanout
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in langs]) if langs else None
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = proof(trees[g], i) + proof(top, at)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if tampered else 0)
            for before, after in steps:
                node = H(before + node + after)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def fields(rows):
    return "doc_id long, source string, lang string, n_chars long, text string, node string, at int", [(*r, "x", 5) for r in rows]


@pytest.mark.parametrize("langs", [["en"], ["en", None, "é", "z", "ab"]])
def test_manifest(spark, langs):
    rng = random.Random(5)
    rows = [(i, rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 3, 10**6]), rng.choice(["", None, "añ" * 9, "t"])) for i in range(70)]
    rows += [rows[3]] * 20 + [(None, None, None, None, None), (-7, "s", "lone", 1, "x" * 100_000)]
    schema, data = fields(rows)
    got = merkle.tampered_proofs(spark.createDataFrame(data, schema))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("fanout, depth", [(2, 1), (3, 2), (4, 1)])
def test_manifest_of_other_fanouts(spark, fanout, depth):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(40)]
    schema, data = fields(rows)
    found = merkle.manifest(spark.createDataFrame(data, schema), fanout=fanout, depth=depth)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root")
    want = [(r[0], r[1], r[2], r[3], r[4], r[3]) for r in plain_manifest(rows, fanout)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_manifest_of_one_row_and_of_none(spark):
    schema, data = fields([(1, "s", "en", 4, "text")])
    one = merkle.tampered_proofs(spark.createDataFrame(data, schema)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")
    assert merkle.tampered_proofs(spark.createDataFrame([], schema)).count() == 0


def licence_rows():
    notices = licenses.BASE + licenses.MORE
    rows = [(1, None), (2, ""), (3, "MIT License. mit license mit mit license"), (4, "the Gnu general, PUBLIC license! General Public Licenses")]
    rows += [(5, "x " * 5000 + "Apache license"), (6, "mit " * 20000 + "license"), (7, "MİT Lİcense"), (7, "mit liKense"), (8, "mit license"), (8, "mit license")]
    rows += [(20 + i, f"zz {t.text.upper()} end, {t.text}") for i, t in enumerate(notices)]
    return rows + [(60 + i, " ".join(w if k % 5 else "foo" for k, w in enumerate(licenses.split(t.text)))) for i, t in enumerate(notices)]


def test_licences_against_sql_and_plain_python(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = frame(spark, licence_rows())
    found = licenses.scan(docs)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841 - DuckDB reads it by name
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    assert check.difference(found, con, queries.ORACLES["op12_license_scan"]) is None
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.where("doc_id < 20").collect() if r.n_words)
    want = []
    for doc, text in licence_rows()[:10]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        hits = {t.label: [i for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()] for t in licenses.BASE}
        places = sorted(sum(hits.values(), []))
        if words:
            want.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, v in hits.items() if v))))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_licences_name_each_template_and_keep_other_columns(spark):
    notices = licenses.BASE + licenses.MORE
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, licence_rows())).collect()}
    for i, t in enumerate(notices):
        assert t.label in rows[20 + i].labels.split(",") and rows[20 + i].score == 1.0
    docs = frame(spark, [(1, "MIT license")]).withColumns({"words": F.lit(1), "spots": F.lit(2), "row": F.lit(3), "present": F.lit(4)})
    found = licenses.find_licenses(docs)
    assert found.columns == [*docs.columns, "license_words", "licenses"]
    assert found.first()["row"] == 3 and found.first()["key"] == "clash" and found.first()["licenses"][0]["label"] == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = licenses.scan(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_collocations(rows, threshold=10, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        inner = {q for p, a in often.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * often[q]}
        found = []
        for p, a in often.items():
            if p not in inner:
                cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:first]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrases(seed=3):
    rng = random.Random(seed)
    words = ["A", "b", "é", "x\x00y", "of", "THE", "İ", " ", "kK", "\x1c", "und"]
    ends = [" ", "  ", "\t", ".", " ", " ", "\n", "\r", "\x0b"]
    rows = [(rng.choice(["en", None, "und", "de"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(250)]
    return rows + [("en", None), ("en", ""), (None, ".,;"), ("zz", "w " * 3000), ("zz", "w\n" * 30)] + [("en", "same same text here")] * 40


@pytest.mark.parametrize("first", [5, 2000])
def test_collocations(spark, first):
    rows = phrases()
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "lang string, text string, phrase string, size int")
    assert sorted(tuple(r) for r in collocations.collocations(docs, first=first).collect()) == plain_collocations(rows, first=first)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_counts_in_small_parts(monkeypatch):
    """Texts cut into blocks and handed on in many parts give the counts of whole texts."""
    for name, value in (("BLOCK", 64), ("HELD", 50), ("BUFFER", 30), ("WORDS", 12)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.blocks, "__defaults__", (64,))
    rows = [(lang or "und", (text or "").encode()) for lang, text in phrases()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    got, parts = Counter(), 0

    def emit(counts):
        for a, b, c, n in zip(*counts.parts(counts.keys).tolist(), counts.n.tolist()):
            got[counts.langs[c], *(counts.words[x] for x in (a, b, c) if x)] += n
        for i, n in enumerate(counts.single.tolist()):
            if n and i > 1:
                got[counts.langs[i], counts.words[i]] += n
        yield 1

    parts = sum(collocations._counted([batch], emit))
    want = Counter()
    for lang, text in rows:
        for piece in re.split(b"[.,;:!?\n-\r]", text.decode().translate(LOWER).encode()):
            words = re.findall(b"[^ \t]+", piece)
            want.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert parts > 10 and got == want


@pytest.mark.parametrize("seed", range(4))
def test_summaries_keep_what_is_frequent(seed):
    rng = np.random.default_rng(seed)
    keys = (rng.zipf(1.2, 20_000) % 5000).astype(np.uint32)
    summary = collocations.Summary(len(keys), 10)
    for part in np.array_split(keys, 37):
        some, n = np.unique(part, return_counts=True)
        summary.merge(some, n)
    kept = set(summary.frequent().tolist())
    true = Counter(keys.tolist())
    assert {k for k, n in true.items() if n >= 10} <= kept and summary.cut < 10
    assert len(summary.keys) <= summary.capacity
    assert all(n <= true[k] <= n + summary.cut for k, n in zip(summary.keys.tolist(), summary.n.tolist()))


def test_scores_beyond_64_bits(spark):
    a, left, right = 987_654_321_012, 999_999_999_989, 998_877_665_544_331
    row = spark.range(1).select(collocations.floor_score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)
