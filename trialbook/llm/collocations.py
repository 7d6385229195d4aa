"""Collocations: phrases of two and three words that stand together more often than their parts
let expect, by language.

First pass. Each task counts the n-grams of its texts exactly in a summary of bounded size and
hands it on, split by hash partition, whenever it is full; a summary comes with its mass (the
occurrences it stands for). The summaries of a hash partition are merged as Misra-Gries
summaries: they are added up, and what is over the capacity is cut by the count of the first
n-gram beyond it. The capacity is over the partition's mass divided by the threshold (``ROOM``
times that), so all cuts together take less than the threshold from an n-gram, and every one that
occurs that often survives. An n-gram occurs at most as often as its counter and the cuts tell,
so of the survivors those below the threshold by that bound are left out too. The masses are
sorted before the summaries of their partition, so the capacity is known from the first one on.

The survivors mark the bits of a bitmap of fixed size by their hash; a hash partition is a range
of hashes and fills its own stretch.

Second pass. The texts are read again, and words and the n-grams whose bit is set are counted by
their text, which is exact: the bitmap only leaves out what is too rare. Scores, joins with the
parts, and ranks are DataFrame operations on the phrases over the threshold.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices
from trialbook.operators.attach import attach, planned_bytes
from trialbook.operators.ordering import top_n
from trialbook.session import pin, released_shuffles

THRESHOLD, CONTAINED, FIRST = 10, 50, 2000
UNKNOWN = "und"
#: Bits of the bitmap, as a power of two: 16 MiB whatever the corpus.
BITMAP = 27
#: Capacity of a summary, in masses divided by the threshold.
ROOM = 2
#: Bytes of the table for one hash partition, and the least and most number of partitions.
PARTITION_BYTES, LEAST_PARTITIONS, MOST_PARTITIONS = 32 << 20, 64, 1 << 20
#: A task hands its counts on beyond so many different n-grams, occurrences or words.
HELD, OCCURRENCES, WORDS = 1 << 20, 1 << 30, 1 << 18
#: Bytes of text cut into words at once (half as many words at most), and n-grams sorted at once.
BLOCK, BUFFER = 1 << 18, 1 << 20

_SPACE, _BORDER = 0, 1
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09",
    b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n\n ",
)


def blocks(data: bytes, size: int = BLOCK):
    """A folded text in blocks that end at a space or border; a longer word is one block."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b"\n", at, end), data.rfind(b" ", at, end))
            if cut < 0:
                found = [x for x in (data.find(b"\n", end), data.find(b" ", end)) if x >= 0]
                cut = min(found, default=len(data))
            end = cut + 1
        yield data[at:end]
        at = end


class Counts:
    """Exact counts of words and n-grams (of two and three words) of a part of the texts.

    A word has a number below 2^20 within the part, so that an n-gram is one 64-bit number and
    equal numbers are equal n-grams of one language. With ``marks``, a packed bitmap, only n-grams
    whose bit is set are kept.
    """

    def __init__(self, marks: np.ndarray | None = None):
        self.marks = marks
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = [b"", b"\n"]
        self.langs: list[str] = ["", ""]
        self.hashed: list[int] = [0, 0]
        self.reset()

    def reset(self) -> None:
        self.single = np.zeros(0, np.int64)
        self.pending: list[np.ndarray] = []
        self.waiting = self.mass = 0
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lang: str, block: bytes, before: list[bytes]) -> list[bytes]:
        """Counts a block of a folded text behind the words ``before``, and returns its last two."""
        known = self.numbers.setdefault(lang, {b"": _SPACE, b"\n": _BORDER})
        words = [*before, *filter(None, block.replace(b"\n", b" \n ").split(b" "))]
        seed = xxhash.xxh64_intdigest(lang.encode())
        for word in set(words).difference(known):
            known[word] = len(self.words)
            self.words.append(word)
            self.langs.append(lang)
            self.hashed.append(xxhash.xxh64_intdigest(word, seed))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self._count(ids[len(before) :])
        self._pairs(ids, len(before))
        return words[-2:]

    def _count(self, ids: np.ndarray) -> None:
        if len(self.single) < len(self.words):
            self.single = np.concatenate([self.single, np.zeros(2 * len(self.words) - len(self.single), np.int64)])
        used, n = np.unique(ids, return_counts=True)
        self.single[used] += n

    def _pairs(self, ids: np.ndarray, old: int) -> None:
        """N-grams that end behind the first ``old`` words; none across a border. A number of
        three words has the first one above bit 40, of two words nothing there."""
        word = ids != _BORDER
        two = word[:-1] & word[1:]
        pairs = ids[:-1] << 20 | ids[1:]
        three = two[:-1] & word[2:]
        triples = ids[:-2] << 40 | pairs[1:]
        for found in (pairs[max(old - 1, 0) :][two[max(old - 1, 0) :]], triples[max(old - 2, 0) :][three[max(old - 2, 0) :]]):
            if len(found):
                self.pending.append(found)
                self.waiting += len(found)

    def settle(self) -> None:
        """Put the waiting n-grams to the sorted counts."""
        if self.pending:
            keys, n = np.unique(np.concatenate(self.pending), return_counts=True)
            self.mass += self.waiting
            self.pending, self.waiting = [], 0
            if self.marks is not None:
                place = self.hashes(keys) >> np.uint64(64 - BITMAP)
                bit = self.marks[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1
                keys, n = keys[bit == 1], n[bit == 1]
            self.keys, self.n = added([self.keys, keys], [self.n, n])

    def full(self) -> bool:
        return len(self.keys) > HELD or self.mass > OCCURRENCES or self.crowded()

    def crowded(self) -> bool:
        return len(self.words) > WORDS

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the three words of each n-gram; the first is 0 for two words."""
        low = (1 << 20) - 1
        return np.stack([keys >> 40, keys >> 20 & low, keys & low])

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each n-gram with its language."""
        of_word = np.array(self.hashed, np.uint64)
        a, b, c = (of_word[x] for x in self.parts(keys))
        return _mixed(_mixed(_mixed(a) + b) + c)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their counts."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n, first) if len(first) else n[:0]


class Summary:
    """A Misra-Gries summary of a hash partition with known mass: counts that are too low by
    ``cut`` at most, which stays below ``threshold``, of at most ``capacity`` keys between merges."""

    def __init__(self, mass: int, threshold: int):
        self.threshold, self.cut = threshold, 0
        self.capacity = ROOM * mass // threshold + 1
        self.keys, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def merge(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.more.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > self.capacity:
            self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        self.keys, self.n = added([self.keys, *(k for k, _ in self.more)], [self.n, *(n for _, n in self.more)])
        self.more, self.waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            # the largest count beyond the capacity; capacity + 1 counters lose that much each
            most = int(np.partition(self.n, over - 1)[over - 1])
            kept = self.n > most
            self.keys, self.n, self.cut = self.keys[kept], self.n[kept] - most, self.cut + most

    def frequent(self) -> np.ndarray:
        """The keys that may have occurred ``threshold`` times."""
        self.settle()
        return self.keys[self.n + self.cut >= self.threshold]


SUMMARY = "part int, kind int, mass long, keys binary, counts binary"


def _counted(batches, emit, marks=None):
    """Runs the texts of (lang, text) batches through one ``Counts`` and yields what ``emit``
    makes of it whenever it is full. ``marks``: a broadcast bitmap."""
    counts = Counts(marks and marks.value)
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            before: list[bytes] = []
            for block in blocks(text.translate(_FOLD)):
                before = counts.add(lang, block, before)
                if counts.waiting >= BUFFER or counts.crowded():
                    counts.settle()
                if counts.full():
                    yield from emit(counts)
                    counts.forget() if counts.crowded() else counts.reset()
    counts.settle()
    yield from emit(counts)


def _summaries(batches, bits: int):
    """Rows of SUMMARY: of each hash partition the mass (kind 0) and the counts (kind 1)."""

    def emit(counts: Counts):
        hashes = counts.hashes(counts.keys)
        order = np.argsort(hashes)
        hashes, n = hashes[order], counts.n[order].astype(np.uint32)
        cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        ends = [0, *cuts.tolist(), len(hashes)]
        # the 32 bits behind those of the partition; n-grams that share them count as one
        hashes = (hashes >> np.uint64(32 - bits)).astype(np.uint32)
        rows = []
        for part in range(1 << bits):
            at, end = ends[part], ends[part + 1]
            if at < end:
                rows.append((part, 0, int(n[at:end].sum()), None, None))
                rows.append((part, 1, 0, hashes[at:end].tobytes(), n[at:end].tobytes()))
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    yield from _counted(batches, emit)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, mass, keys, counts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(mass, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
        names=["part", "kind", "mass", "keys", "counts"],
    )


def _survivors(batches, bits: int, threshold: int):
    """(part, bits): the part's stretch of the bitmap. Rows come in the order of part and kind."""
    stretch = 1 << (BITMAP - bits)

    def marked(part: int, summary: Summary) -> pa.RecordBatch:
        flags = np.zeros(stretch, bool)
        flags[summary.frequent() >> np.uint32(32 - BITMAP + bits)] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bits"])

    part, mass, summary = None, 0, None
    for batch in batches:
        for at in range(batch.num_rows):
            now, kind, more, keys, counts = (column[at].as_py() for column in batch.columns)
            if now != part:
                if summary is not None:
                    yield marked(part, summary)
                part, mass, summary = now, 0, None
            if kind == 0:
                mass += more
                continue
            summary = summary or Summary(mass, threshold)
            summary.merge(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64))
    if summary is not None:
        yield marked(part, summary)


def bitmap(texts: DataFrame, threshold: int) -> np.ndarray:
    """The bitmap of the hashes of all n-grams that may occur ``threshold`` times, packed."""
    wanted = -(-planned_bytes(texts) // PARTITION_BYTES)
    bits = max(LEAST_PARTITIONS, min(MOST_PARTITIONS, wanted)) - 1
    bits = int(bits).bit_length()
    found = texts.mapInArrow(partial(_summaries, bits=bits), SUMMARY)
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(min(1 << bits, max(least, 64)), "part").sortWithinPartitions("part", "kind")
    with released_shuffles(texts.sparkSession):
        stretches = dealt.mapInArrow(partial(_survivors, bits=bits, threshold=threshold), "part int, bits binary").collect()
    # 16 MiB in all, however many rows and n-grams there are
    whole = np.zeros(1 << (BITMAP - 3), np.uint8)
    size = len(whole) >> bits
    for row in stretches:
        whole[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole


PHRASES = "lang string, size int, phrase binary, f long"


def phrase_counts(texts: DataFrame, threshold: int) -> DataFrame:
    """(lang, size, phrase, f): words and phrases that occur at least ``threshold`` times, and
    under size 0 each language's number of words. ``texts``: lang, text (binary)."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap(texts, threshold))

    def emit(counts: Counts):
        first, second, third = counts.parts(counts.keys)
        langs, words = counts.langs, counts.words
        used = np.flatnonzero(counts.single)
        used = used[used > _BORDER]
        totals: dict[str, int] = {}
        for i in used.tolist():
            totals[langs[i]] = totals.get(langs[i], 0) + int(counts.single[i])
        rows = [(lang, 0, b"", n) for lang, n in totals.items()]
        rows += [(langs[i], 1, words[i], n) for i, n in zip(used.tolist(), counts.single[used].tolist())]
        for at in range(0, len(rows), 1 << 14):
            yield listed(rows[at : at + (1 << 14)])
        for at in range(0, len(counts.keys), 1 << 14):
            some = slice(at, at + (1 << 14))
            rows = [
                (langs[c], 3 if a else 2, words[a] + b" " + words[b] + b" " + words[c] if a else words[b] + b" " + words[c], n)
                for a, b, c, n in zip(first[some].tolist(), second[some].tolist(), third[some].tolist(), counts.n[some].tolist())
            ]
            yield listed(rows)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        lang, size, phrase, f = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()), pa.array(f, pa.int64())],
            names=["lang", "size", "phrase", "f"],
        )

    found = texts.mapInArrow(partial(_counted, emit=emit, marks=held), PHRASES)
    summed = found.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return pin(summed.where((F.col("f") >= threshold) | (F.col("size") == 0)))


def floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers; exact for counts below 10^16."""
    wide = "decimal(38,0)"
    times = F.lit(1_000_000).cast(wide) * (a.cast("decimal(19,0)") * a.cast("decimal(19,0)")).cast(wide)
    return F.call_function("div", times, (left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast(wide)).cast("long")


def scored(counts: DataFrame) -> DataFrame:
    """Every phrase of two or three words with the lowest-scoring of its cuts: lang, phrase, a,
    l, r, score, and words (as an array)."""
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    rows = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = rows.select("lang", "phrase", "a", "words", "size", cut)
    ends = {"l": F.slice("words", F.lit(1), F.col("k")), "r": F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))}
    for name, words in ends.items():
        of = parts.select("lang", F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = attach(cuts.withColumn("_part", F.array_join(words, " ")), of, ["lang", "_part"], "inner").drop("_part")
    cuts = cuts.withColumn("score", floor_score(F.col("a"), F.col("l"), F.col("r")))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    threshold: int = THRESHOLD,
    contained: int = CONTAINED,
    first: int = FIRST,
) -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and the pieces
    into words at spaces and tabs. a: occurrences of a phrase of two or three words within
    pieces, at least ``threshold``; l, r: those of its two parts at the cut with the lowest
    score; n: all words of the language. A phrase that stands inside a longer one with at least
    ``contained`` percent of its occurrences is left out. Ties go to the higher a, then to the
    lower phrase in UTF-8.

    A null language is ``und``; null and empty texts have no words; repeated rows count each
    time; other columns do not matter. An empty table, and one without phrases, gives no rows.
    """
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    counts = phrase_counts(texts, threshold)
    longer = counts.where("size = 3").select("lang", F.col("f").alias("over"), F.split("phrase", " ").alias("w"))
    inner = F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2])))
    covers = longer.select("lang", inner.alias("phrase"), "over").groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    found = pin(scored(counts))
    found = found.join(covers, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < contained * F.col("a")))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    best = top_n(found.drop("over"), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], first)
    ranked = attach(best, totals, ["lang"], "inner")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
