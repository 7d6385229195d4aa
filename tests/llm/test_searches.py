"""Decontamination, personal data and secrets against brute force and plain expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import frame
from trialbook.llm import decontamination, pii, secret_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected_hits(text, items, width=10):
    words, hit, found = WORD.findall(low(text)), set(), set()
    for ident, item in items:
        of = WORD.findall(low(item))
        size = min(width, len(of))
        for i in range(len(of) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == of[i : i + size]:
                    hit.update(range(j, j + size))
                    if ident is not None:
                        found.add(str(ident))
    return len(words), len(hit), sorted(found)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def passages():
    draw = random.Random(11)
    vocab = ["a", "b", "c", "É", "dog", "x1", "ÀB", "_"]
    line = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 14, 30])] + [(50, None), (51, "A b. C"), (51, "dog dog dog dog"), (None, "b b b b b b")]
    texts = [line(draw.randrange(60)) for _ in range(60)] + [None, "", "..", line(400), *(t.upper() + "!" for _, t in items if t)]
    return items, texts


@pytest.mark.parametrize("least", [4, 1])
def test_windows_equal_brute_force(least):
    items, texts = passages()
    items = [x for x in items if x[1] and len(WORD.findall(x[1])) >= least]
    windows = decontamination.Windows(items, 10)
    for text in texts:
        words = decontamination.words_of(text)
        spans, found = windows.search(words)
        got = len(words), sum(b - a for a, b in spans), sorted({str(windows.item_ids[i]) for i in found} - {"None"})
        assert got == expected_hits(text, items)


def test_random_long_windows():
    draw = random.Random(2)
    for _ in range(300):
        item = " ".join(draw.choice("abc") for _ in range(draw.randrange(1, 14)))
        text = " ".join(draw.choice("abc") for _ in range(80)) + " " + item
        windows = decontamination.Windows([(1, item)], 5)
        spans, _ = windows.search(decontamination.words_of(text))
        assert sum(b - a for a, b in spans) == expected_hits(text, [(1, item)], 5)[1]


def test_search_in_one_block_and_in_many(spark):
    items, texts = passages()
    docs, bench = frame(spark, list(enumerate(texts)) + [(None, "a b"), (3, "A b c")]), benchmark(spark, items)
    for chars in (10**6, 40):
        found = decontamination.search_passages(docs, bench, block_chars=chars)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= decontamination.PASSES
        got = found.collect()
        by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 3)}
        for i, text in enumerate(texts):
            if i != 3:
                n, hit, ids = expected_hits(text, items)
                r = by_id[i]
                assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids), sha(",".join(ids)), hit > 0)
        assert len(got) == len(texts) + 2
    assert decontamination.search_passages(docs.limit(0), bench).count() == 0
    assert decontamination.search_passages(docs, bench.limit(0)).where("contaminated").count() == 0


def test_other_columns_stay_only_if_asked(spark):
    docs, bench = frame(spark, [(1, "a b"), (2, "c")]), benchmark(spark, [(1, "a b"), (2, "c d"), (3, "e f g")])
    results = ["n_words", "hit_spans", "n_hit", "n_items", "items_sha256", "contaminated"]
    for chars in (10**6, 2):
        assert decontamination.search_passages(docs, bench, block_chars=chars).columns == ["doc_id", *results]
        assert decontamination.search_passages(docs, bench, block_chars=chars, keep=True).columns == [*docs.columns, *results]


def test_contaminated_rows_go_and_columns_stay(spark):
    docs = frame(spark, [(1, "one two three four five six seven eight nine ten"), (2, "clean"), (None, None)])
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("hit_spans", F.lit(1))
    kept = decontamination.remove_contaminated(docs, benchmark(spark, [(1, "Zero one two three four five six seven eight nine ten")]))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


# --- personal data ---------------------------------------------------------------------


def expected_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(n if i % 2 == 0 else sum(map(int, str(n * 2))) for i, n in enumerate(map(int, reversed(digits))))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def personal():
    draw = random.Random(4)
    yield from ["", "a@b.c", "@b.c", "a@b", "a@b..c", "a@b.c@d.e", "x.y@z.-.com. ", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.02.3.4"]
    yield from ["4111 1111 1111 1111", "4111-1111-1111-1111x", "+1 (555) 010-9999", "+12345678", "+1", "+1 ", "++12 345 678 9", "é+49 30 1234567.", "1 1 1.1.1.1"]
    yield from ["9" * 5000, "1." * 3000, "a@" * 3000, "+1" * 2000, "1-" * 3000, "😀a@b.co 4111111111111111"]
    for letters in ("a@.b", "1. ", "12.-", "+1 ()-.", "41 -", "a@.1+ -", "0123456789 -"):
        for n in (6, 12, 25, 60, 200):
            for _ in range(60):
                yield "".join(draw.choice(letters) for _ in range(n))


def test_base_spans_equal_the_expressions():
    for text in personal():
        assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == expected_pii(text), text[:80]


def test_links_and_accounts():
    found = pii.spans_of("see https://a.example/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32 now; IBAN GB00 WEST 1234 5698 7654 32")
    assert [s for s in found if s[0] == "url"] == [("url", 4, 27)]
    assert [s[:2] for s in found if s[0] == "account"] == [("account", 35)]


def test_anchors_in_any_case_and_with_words_between():
    number = "GB82 WEST 1234 5698 7654 32"
    for cue in ("iBAN", "IBAN no. ", "IBAN\t", "Account number: ", "ACCT #", "account (no) "):
        text = f"\u0130 {cue}{'' if cue[-1] in ' \t#' else ' '}{number}."
        assert [text[a:b] for k, a, b in pii.spans_of(text) if k == "account"] == [number], cue
    text = "\u0130 HTTP://A.example/x, Https://b.example"
    assert [text[a:b] for k, a, b in pii.spans_of(text) if k == "url"] == ["HTTP://A.example/x", "Https://b.example"]
    assert pii.spans_of("account of GB82 nothing, IBAN") == []


def test_personal_rows(spark):
    docs = frame(spark, [(1, "a@b.c +49 30 1234567"), (1, "a@b.c +49 30 1234567"), (2, None), (3, ""), (None, "1.2.3.4")])
    got = pii.find_personal_data(docs.withColumn("spans", F.lit(1))).collect()
    assert len(got) == 5
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_email"], one["n_phone"], one["spans"], one["base_sha256"]) == (1, 1, "email:0:5,phone:6:20", sha("email:0:5,phone:6:20"))
    assert {r["base_sha256"] for r in got if r["doc_id"] in (2, 3)} == {sha("")}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


# --- secrets ---------------------------------------------------------------------------


def expected_secrets(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate((r.kind, r.pattern, r.group, r.least) for r in secret_scan.BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def secret_texts():
    draw = random.Random(8)
    yield from ["", "password=abcdefgh", "PassWord : 'abcdefghi'", "token=secret:abcdefghij", "api_key=\"aaaaaaaa\"", "apikey:short", "éé token=aaaaaaaa😀 secret=bbbbbbbbb"]
    yield from ["AKIA" + "A" * 12, "AKIA" + "A" * 11, "xAKIAAKIAAKIAAKIA", "a" * 31, "a" * 32, "g" + "0f" * 40, "AKIA", "passwd==aaaaaaaaa", "secret:" + "x" * 5000]
    pieces = ["password", "TOKEN", "secret", "api_key", "=", ":", " ", "'", "abcdefgh", "AKIA", "0123456789ABCDEF", "0123456789abcdef", "é", "x", "\n"]
    for n in (3, 6, 12, 40):
        for _ in range(60):
            yield "".join(draw.choice(pieces) for _ in range(n))


def test_queries_of_the_rules():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE}
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and len(q["assign"]) == 6
    assert q["access"] == frozenset({frozenset({"aki", "kia"})})
    assert q["hex"] == frozenset()
    assert secret_scan.trigram_query("ab?c") == frozenset()
    assert secret_scan.trigram_query("(abc|def)+x*ghi") == frozenset({frozenset({"abc", "ghi"}), frozenset({"def", "ghi"})})


def test_secrets_equal_the_expressions(spark):
    texts = list(secret_texts())
    docs = frame(spark, [*enumerate(texts), (None, None), (0, "token=aaaaaaaa")]).withColumn("rules", F.lit("clash"))
    found = secret_scan.find_secrets(docs, rules=secret_scan.BASE)
    assert not any(k in found._jdf.queryExecution().toString() for k in ("Python", "Pandas", "Arrow"))
    got = found.collect()
    assert len(got) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 0)}
    for i, text in enumerate(texts):
        if i:
            want = expected_secrets(text)
            assert (by_id[i]["spans"], by_id[i]["base_sha256"]) == (want, sha(want)), text[:80]
            assert by_id[i]["n_hex"] == want.count("hex:") and by_id[i]["n_assign"] == want.count("assign:")
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_blocks_are_bounded_for_repeated_and_long_items(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, "the same benchmark row again and again in one long list " * 3)] * 200 + [(2, " ".join(words)), (3, None), (4, "")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    sizes = [sum(len(r["text"]) for r in b.collect()) for b in decontamination.blocks(bench, "item_id", "text", 2000)]
    assert max(sizes) < 4 * 2000 and len(sizes) > 5
    docs = frame(spark, [(k, " ".join(words[k : k + 10])) for k in range(0, 2991, 13)] + [(5000, " ".join(words[:9])), (5001, " ".join(words[-9:]))])
    got = {r["doc_id"]: r for r in decontamination.search_passages(docs, bench, block_chars=2000).collect()}
    assert all(r["contaminated"] == (d < 5000) and r["n_items"] == (d < 5000) for d, r in got.items())
    whole = decontamination.Windows([(0, " ".join(words))], 10).classes[0][3]
    cut = decontamination.Windows([(0, p) for p in decontamination.pieces(" ".join(words), 10, 100)], 10)
    assert [c[0] for c in cut.classes] == [10] and cut.classes[0][3].keys() == whole.keys()
