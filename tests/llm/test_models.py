"""Token counts, quality rules, WARC archives, registered queries and the pipeline."""

import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.tables import frame
from trialbook.llm import bpe, quality, queries, token_counts, warc
from trialbook.plans import check

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_count(pieces, text, fallback=True):
    """All starts from the left, better scores only: (pieces, score)."""
    scores = dict(pieces)
    low = min(scores.values()) - 10
    best = [(0.0, 0, False)] + [None] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if (s := scores.get(text[i:j])) is not None:
                found = (best[i][0] + s, best[i][1] + 1, False)
            elif j == i + 1:
                extra = len(text[i].encode()) if fallback else int(not best[i][2])
                found = (best[i][0] + low, best[i][1] + extra, True)
            else:
                continue
            if best[j] is None or found[0] > best[j][0]:
                best[j] = found
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_brute_force_with_ties(fallback):
    draw = random.Random(2)
    for _ in range(60):
        names = {"".join(draw.choice("ab▁é") for _ in range(draw.randrange(1, 4))) for _ in range(8)} | {"▁"}
        pieces = [(p, float(-draw.randrange(1, 5))) for p in names]
        vocabulary = token_counts.Vocabulary(pieces, fallback)
        for _ in range(20):
            text = "".join(draw.choice("ab cé") for _ in range(draw.randrange(12)))
            marked = "▁" + text.replace(" ", "▁") if text else ""
            assert vocabulary.total(text) == brute_count(pieces, marked, fallback)


def test_counts_equal_the_library():
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.load(PIECES)
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    size = model.get_piece_size()
    ordinary = [(model.id_to_piece(i), model.get_score(i)) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *ordinary], unk_id=0, byte_fallback=False))
    draw = random.Random(1)
    words = ["the", " ", "token", "ization", "  ", "naïve", "été", "x", ".", "1999", "über", "aa"]
    for _ in range(200):
        text = "".join(draw.choice(words) for _ in range(draw.randrange(1, 40)))
        assert vocabulary.total(text)[0] == len(unigram.encode("▁" + text.replace(" ", "▁")).ids)


def test_count_rows(spark):
    docs = frame(spark, [(1, "the word"), (1, "the word"), (2, None), (3, ""), (None, "漢" * 3), (4, "ab " * 30_000)])
    got = token_counts.count_tokens(docs.withColumn("score", F.lit("clash")), PIECES).collect()
    assert len(got) == 6 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


# --- quality ---------------------------------------------------------------------------


def test_rules_find_a_conjunction():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(int)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 150
    score = np.full(len(x), model.bias)
    for rule, w in model.rules:
        score += w * np.all([(x[:, "abc".index(k)] > t) == above for k, above, t in rule], axis=0)
    assert ((score > 0) == y).mean() > 0.97


def test_without_labels_or_with_one_kind(spark):
    docs = frame(spark, [(1, "a text"), (2, None), (3, "")])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = quality.score_quality(docs, quality.fit_quality(docs, some)).collect()
        assert len(got) == 3 and all(0.3 <= r["score"] <= 1 and r["predicted"] == 1 for r in got)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.93
    assert got.count() == 1000


def test_quality_keeps_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("stats", F.lit("clash")).withColumn("_words", F.lit(1))
    kept = quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.columns == docs.columns and 100 < kept.count() < 200


# --- WARC ------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def page_rows():
    tricky = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    return [
        (1, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/y", "<p>é</p>"), (3, None, None), (4, "http://b.example", ""),
        (5, "http://c.example/WARC/1.0", tricky), (6, "odd\r\nurl WARC/1.0", tricky), (7, "ftp://d", "\r\n\r\n"), (8, "http://e", "z" * 200_000),
        (None, "http://f", "<p>é</p>"), (None, "http://g", "only null"), (9, "http://h", "twice"), (9, "http://h", "twice"), (10, "http://i", "twice"),
    ]


def expected_pages(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "").encode() == body and p is not None), default=None)
        kind = "response" if page == first else "revisit"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, kind, None if kind == "response" else first))
    return sorted(out, key=str)


def test_archives_give_the_pages_back(spark, tmp_path):
    rows = page_rows()
    table = pages(spark, rows).withColumn("_digest", F.lit("clash")).withColumn("record_type", F.lit(1))
    got = warc.archived(table, str(tmp_path / "w")).collect()
    assert sorted(map(tuple, got), key=str) == expected_pages(rows)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    bodies = {bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()}
    assert bodies == {(h or "").encode() for _, _, h in rows}
    nested = warc.captures(records).collect()
    assert len(nested) == len(rows) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in nested)
    assert warc.archived(table.limit(0), str(tmp_path / "none")).count() == 0


def test_small_payloads_are_responses(spark, tmp_path):
    table = pages(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")])
    warc.write_archives(table, str(tmp_path / "w"), min_bytes=3)
    got = warc.resolved(warc.captures(warc.read_archives(spark, str(tmp_path / "w")))).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_foreign_and_cut_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = "WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <r>\r\nContent-Type: application/http\r\nContent-Length: {}\r\n\r\n"
    one = head.format(len(body)).encode() + body + b"\r\n\r\n"
    with open(tmp_path / "a.warc.gz", "wb") as file:
        file.write(gzip.compress(one) + gzip.compress(head.format(9999).encode() + body))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["complete"] for r in got] == [True, False] and bytes(got[0]["payload"]) == b"hello"


# --- queries ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder)
    assert check.difference(found, check.duck(folder), queries.ORACLES[name]) is None


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == columns, name
        docs = kept.cache()
        assert 0 < docs.count() <= before
        before = docs.count()
    got = corpus_pipeline.run(spark, folder)
    table, _, _ = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all("".join(bpe.decode(table, [r["token_ids"]])) == (texts[r["doc_id"]] or "") for r in rows)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_records_whose_length_is_no_number(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: many\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"
    good = "WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nContent-Length: 1\r\n\r\ny\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record + good).encode())
    got = {r["record_id"]: (r["complete"], r["block"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got["<a>"] == (False, None) and got["<b>"][0] and bytes(got["<b>"][1]) == b"y"
