"""Benchmark passages in documents by Wu-Manber search over words.

Symbols are words. Windows of one length form a class with two tables: the shift table says,
for the hash block (the last two words of the window under the scan), how far the scan may
jump because no window holds that block nearer to its end; a block that ends some window has
shift 0, and its bucket names the windows to compare word by word. Blocks that no window
holds, nearly all in ordinary text, jump a whole window but one word.

The benchmark is taken in blocks of bounded size, one pass of the documents' tasks each, so
that the driver and a worker hold one block and a task ``PASSES`` of them; beyond these the
rows are written and read again: repeated items count once and
long ones are cut into pieces that overlap by a window less a word. Hits of earlier passes travel
with the row as word spans.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices
from trialbook.session import pin, scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Characters of benchmark text in one pass; its tables take about a hundred times as many bytes.
BLOCK_CHARS = 1_000_000
#: Blocks searched one after the other in a task before the rows are written.
PASSES = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(UPPER)) if text else []


class Windows:
    """Shift and bucket tables of all windows, by window length."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.item_ids: list = [i for i, _ in items]
        by_length: dict[int, dict[tuple[str, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(width, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                by_length[size][tuple(words[at : at + size])].add(number)
        self.classes = []
        for size, windows in sorted(by_length.items()):
            block = min(2, size)
            shift: dict[tuple[str, ...], int] = {}
            bucket: dict[tuple[str, ...], list] = defaultdict(list)
            for window, of in windows.items():
                for end in range(block, size + 1):
                    part = window[end - block : end]
                    shift[part] = min(shift.get(part, size), size - end)
                bucket[window[-block:]].append((window[0], window, tuple(sorted(of))))
            self.classes.append((size, block, shift, dict(bucket)))

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside any window, merged and in order; numbers of the items."""
        spans, found = [], set()
        for size, block, shift, bucket in self.classes:
            furthest, end, n = size - block + 1, size, len(words)
            while end <= n:
                last = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                jump = shift.get(last, furthest)
                if jump:
                    end += jump
                    continue
                first = words[end - size]
                for begins, window, of in bucket[last]:
                    if begins == first and tuple(words[end - size : end]) == window:
                        spans.append((end - size, end))
                        found.update(of)
                end += 1
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces(text: str, width: int, chars: int) -> list[str]:
    """A text of over ``chars`` characters as overlapping runs of its words, with the same
    windows: neighbours share ``width`` - 1 words, and each has at least ``width``."""
    if len(text) <= chars:
        return [text]
    words, out, start = words_of(text), [], 0
    while True:
        end, size = start, 0
        while end < len(words) and (size < chars or end - start < width):
            size += len(words[end]) + 1
            end += 1
        out.append(" ".join(words[start:end]))
        if end == len(words):
            return out
        start = end - width + 1


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int, width: int = 10) -> list[DataFrame]:
    """The different (item, text) of the benchmark in parts of about ``block_chars``
    characters; a longer text counts as its pieces."""

    def cut(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                found = pieces(batch.column(1)[at].as_py(), width, block_chars)
                owner = pa.array([batch.column(0)[at].as_py()] * len(found), pa.string())
                yield pa.RecordBatch.from_arrays([owner, pa.array(found, pa.string())], names=["item", "text"])

    narrow = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    narrow = narrow.where(F.col("text").isNotNull()).distinct()
    long = F.length("text") > block_chars
    cuts = narrow.where(long).mapInArrow(cut, "item string, text string")
    narrow = pin(narrow.where(~long).unionByName(cuts).distinct())
    total = narrow.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [narrow.where(part == k) for k in range(n)] if n > 1 else [narrow]


def search_passages(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, keep: bool = False,
) -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans.

    A window is ``width`` consecutive words of an item, or a shorter item's whole words.
    ``hit_spans``: [start, end) in words. Null text has no words and no hits; null or empty
    items have no windows; a null item_id is left out of the listed ids; items with equal ids
    count once. Repeated rows stay repeated. ``keep``: all columns of ``docs`` stay as well
    (columns named like a result are replaced).
    """
    found = ["n_words", "hit_spans", "items"]
    results = ["n_hit", "n_items", "items_sha256", "contaminated"]
    rows = docs.drop(*found, *results) if keep else docs.select(key, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, n_words long, hit_spans array<array<int>>, items array<string>"
    spark = docs.sparkSession
    parts, listed = blocks(benchmark, item, item_text, block_chars, width), []
    with scratch(spark) as lasting:
        for k, part in enumerate(parts):
            if k and k % PASSES == 0:
                # only the table of the last passes is read again
                rows = (lasting if k == (len(parts) - 1) // PASSES * PASSES else pin)(rows)
                for done in listed:
                    done.unpersist()
                listed = []
            # about block_chars characters
            listed.append(spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()]))
            rows = rows.mapInArrow(_pass(listed[-1], uuid.uuid4().hex, text, width), schema)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    ids = F.array_sort(F.array_distinct("items"))
    rows = rows.withColumns(
        {
            "n_hit": hit,
            "n_items": F.size(ids).cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", ids), 256),
            "contaminated": hit > 0,
        }
    ).drop("items")
    return rows if keep else rows.drop(text)


_TABLES: dict = {}


def _pass(listed, name: str, text: str, width: int):
    """One pass over the rows with one block of the benchmark."""

    def run(batches):
        if name not in _TABLES:  # a worker keeps the tables of the block it last used
            _TABLES.clear()
            _TABLES[name] = Windows(listed.value, width)
        windows = _TABLES[name]
        for batch in slices(batches):
            names = batch.schema.names
            before = names.index("hit_spans") if "hit_spans" in names else None
            n, spans, items = [], [], []
            for row, value in enumerate(batch.column(names.index(text)).to_pylist()):
                words = words_of(value)
                hit, of = windows.search(words)
                of = {windows.item_ids[i] for i in of} - {None}
                if before is not None:
                    hit = merged([*hit, *map(tuple, batch.column(before)[row].as_py())])
                    of |= set(batch.column(before + 1)[row].as_py())
                n.append(len(words))
                spans.append(hit)
                items.append(sorted(of))
            kept = batch.columns if before is None else batch.columns[: before - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(n, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*(names if before is None else names[: before - 1]), "n_words", "hit_spans", "items"],
            )

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, columns as they are, that hold no benchmark window."""
    rows = docs.select(F.struct("*").alias("doc_row"), "text")
    return search_passages(rows, benchmark, width, key="doc_row").where(~F.col("contaminated")).select("doc_row.*")
