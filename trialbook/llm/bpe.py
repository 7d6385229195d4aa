"""Byte-level BPE encoding and decoding as streaming transducers.

The merge list fixes how far right of a position a merge can still depend on later text:
its sufficient lookahead (``MergeTable.lookahead``, in bytes). A run without a pre-token
border is encoded in windows; tokens that end at least that far before the window's end
can no longer change and are emitted, the rest is carried on. Decoding holds back at most
three bytes: those of a character that has not ended yet.

Memory per document is one window of text plus one window of symbols, however long the
text or a single run in it is. Word results are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbook.llm.arrow import slices

# How byte-level BPE splits text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPLIT = regex.compile(PRE_TOKEN)
UNEVEN = re.compile(r" (?:\s|\Z)")
#: What a run goes on with once its first part has been taken, by the class of its last character.
LETTERS, NUMBERS, OTHERS, SPACES = (
    regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s+(?!\S)|\s+")
)
#: A match is final when so many characters after it are known (contractions look two ahead).
MARGIN = 3
CHUNK = 1 << 16
#: Longer pre-tokens are merged with a heap, and are not kept in the word table.
SHORT = 48
WORDS = 100_000
PAIR = 1 << 20
NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeTable:
    """Vocabulary, merges and the lookahead that the merges need."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = special
        self.start = [vocab[letters[b]] for b in range(256)]
        self.spelled: dict[int, bytes] = {
            i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)
        }
        self.spelled.update({i: t.encode() for t, i in special.items()})
        #: Rank of a pair, by left id * PAIR + right id; what the merge of a rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault(vocab[a] * PAIR + vocab[b], rank)
            self.made.append(vocab[a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes right of a token border that can decide whether the border stays.

        A merge (a, b) over the border reaches len(b) further, and whether b exists there
        can hang on an earlier merge that takes a token from b's right edge, and so on with
        ever earlier merges. ``reach[t]``: the furthest such chain that starts with a merge
        whose left side is t, over the merges seen so far in rank order.
        """
        reach: dict[int, int] = {}
        edge: dict[int, int] = {}  # right part of the merge that makes a token
        for pair, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            (a, b), made = divmod(pair, PAIR), self.made[rank]
            furthest, t = 0, b
            while t is not None:
                furthest = max(furthest, reach.get(t, 0))
                t = edge.get(t)
            edge[made] = b
            reach[a] = max(reach.get(a, 0), len(self.spelled[b]) + furthest)
        return max(reach.values(), default=0)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of ``data`` taken alone: lowest rank first, leftmost first."""
        ids = [self.start[b] for b in data]
        if len(ids) > SHORT:
            return self._merged_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a * PAIR + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            new = made[rank]
            ids[i : i + 2] = (new,)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * PAIR + new, NONE)
            if i < len(ranks):
                ranks[i] = get(new * PAIR + ids[i + 1], NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get, n = self.rank.get, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a * PAIR + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] * PAIR + ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := get(ids[a] * PAIR + ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [t for t in ids if t >= 0]


class Recent(dict):
    """A table of bounded size: when full it is set aside, and what is used again comes back."""

    def __init__(self) -> None:
        self.before: dict = {}

    def keep(self, key: str, value: tuple[int, ...]) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Recent):
    """Tokens of pre-tokens, computed when first met."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table
        self.spaced = Spaced(self)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (found := self.before.get(word)) is not None:
            return self.keep(word, found)
        data = word.encode()
        if len(data) > SHORT:
            run = Run(self.table)
            found = list(chain.from_iterable(run.feed(data)))
            return (*found, *run.finish())
        return self.keep(word, tuple(self.table.merged(data)))

    def tokens(self, text: str) -> list[int]:
        """Tokens of a whole text. A space that something other than white space follows
        always begins a pre-token, so an ordinary text is looked up from space to space."""
        if UNEVEN.search(text):
            return list(chain.from_iterable(map(self.__getitem__, SPLIT.findall(text))))
        first, *pieces = text.split(" ")
        ids = list(chain.from_iterable(map(self.__getitem__, SPLIT.findall(first))))
        ids.extend(chain.from_iterable(map(self.spaced.__getitem__, pieces)))
        return ids


class Spaced(Recent):
    """Tokens of what stands between two spaces, with the space before it."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (found := self.before.get(piece)) is not None:
            return self.keep(piece, found)
        first, *more = SPLIT.findall(" " + piece)
        if more:
            found = (*self[first[1:]], *chain.from_iterable(map(self.words.__getitem__, more)))
        elif len(first) < SHORT // 4:
            found = tuple(self.words.table.merged(first.encode()))
        else:
            found = self.words[first]
        return found if len(piece) > SHORT or "\n" in piece else self.keep(piece, found)


class Run:
    """Tokens of one pre-token that comes in parts, each emitted once it is stable."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, b""
        self.window = max(4096, 4 * table.lookahead)

    def feed(self, data: bytes) -> Iterator[list[int]]:
        spelled, lookahead = self.table.spelled, self.table.lookahead
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) >= 2 * self.window:
                ids, end, kept = self.table.merged(self.held), 0, 0
                while end + len(spelled[ids[kept]]) <= len(self.held) - lookahead:
                    end += len(spelled[ids[kept]])
                    kept += 1
                yield ids[:kept]
                self.held = self.held[end:]

    def finish(self) -> list[int]:
        ids, self.held = self.table.merged(self.held), b""
        return ids


def sections(table: MergeTable, chunks: Iterable[str]) -> Iterator[tuple[str, int | None]]:
    """Text without special tokens, and after it the id of the special token that ends it."""
    if not table.special:
        yield from ((c, None) for c in chunks)
        return
    named = regex.compile("|".join(regex.escape(t) for t in sorted(table.special, key=len, reverse=True)))
    longest, held = max(map(len, table.special)), ""
    for chunk in chunks:
        held, at = held + chunk, 0
        for m in named.finditer(held):
            yield held[at : m.start()], table.special[m[0]]
            at = m.end()
        at, until = at, max(at, len(held) - longest + 1)
        yield held[at:until], None
        held = held[until:]
    yield held, None


class Encoder:
    """Pre-token borders and tokens of a text that is fed in pieces."""

    def __init__(self, table: MergeTable, words: Words):
        self.table, self.words = table, words
        self.held, self.run, self.goes_on = "", None, None

    def feed(self, text: str, last: bool = False) -> Iterator[list[int]]:
        self.held += text
        if not last and len(self.held) < CHUNK:
            return
        if self.run is not None:
            yield from self._go_on(last)
        if self.run is None:
            if last:
                yield self.words.tokens(self.held)
                self.held = ""
                return
            found = SPLIT.findall(self.held)
            kept, end = len(found), len(self.held)
            while kept and end > len(self.held) - MARGIN:
                kept -= 1
                end -= len(found[kept])
            yield list(chain.from_iterable(map(self.words.__getitem__, found[:kept])))
            self.held = self.held[end:]
            if kept < len(found) and len(found[kept]) > CHUNK // 2:
                yield from self._begin(found[kept])

    def _begin(self, first: str) -> Iterator[list[int]]:
        """The pre-token that begins here is long: merge it as it comes."""
        kinds = (SPACES if first[-1].isspace() else None, LETTERS, NUMBERS, OTHERS)
        self.goes_on = next(k for k in kinds if k is not None and k.fullmatch(first[-MARGIN:]))
        self.run = Run(self.table)
        yield from self.run.feed(first[:-MARGIN].encode())
        self.held = self.held[len(first) - MARGIN :]

    def _go_on(self, last: bool) -> Iterator[list[int]]:
        found = self.goes_on.match(self.held)
        end = found.end() if found else 0
        ended = last or end <= len(self.held) - MARGIN
        end = end if ended else max(0, end - MARGIN)
        yield from self.run.feed(self.held[:end].encode())
        self.held = self.held[end:]
        if ended:
            yield self.run.finish()
            self.run = None


def encode(table: MergeTable, words: Words, chunks: Iterable[str]) -> Iterator[list[int]]:
    """Token ids of a text that comes in chunks, as lists that follow each other."""
    encoder = Encoder(table, words)
    for text, special in sections(table, chunks):
        yield from encoder.feed(text, last=special is not None)
        if special is not None:
            yield [special]
    yield from encoder.feed("", last=True)


def chunked(text: str, size: int = CHUNK) -> Iterator[str]:
    return (text[i : i + size] for i in range(0, len(text), size))


class Utf8:
    """Bytes in pieces to text: a state machine whose state is the begun character's bytes."""

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.begun + data
        keep = 0 if last else self._open(data)
        self.begun = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes may complete."""
        for k in range(1, min(3, len(data)) + 1):
            lead = data[-k]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= k:
                return 0
            second = data[-k + 1] if k > 1 else None
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
                lead, (0x80, 0xBF)
            )
            return k if second is None or low <= second <= high else 0
        return 0


def decode(table: MergeTable, ids: Iterable[list[int]]) -> Iterator[str]:
    """Text of token ids that come in lists; unknown ids give no text."""
    state, spelled = Utf8(), table.spelled
    for some in ids:
        yield state.feed(b"".join([spelled.get(t, b"") for t in some]))
    yield state.feed(b"", last=True)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[MergeTable, Words, dict[int, str]]:
    """Merge table, word table and ids as text of a tokenizer file; once per worker."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = MergeTable(spec["model"]["vocab"], merges, special)
    return table, Words(table), {i: str(i) for i in table.spelled}


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids of ``text`` in a new last column ``ids``.

    Null text gives an empty array. A column that is already called ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    schema = f"{ids} array<int>"

    def run(batches):
        table, words, _ = load(path)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            coded = [list(chain.from_iterable(encode(table, words, chunked(t or "")))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(coded, pa.list_(pa.int32()))], names=[*batch.schema.names, ids]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {schema}")


def decode_column(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids; null ids give an empty text."""
    docs = docs.drop(text)

    def run(batches):
        table, _, _ = load(path)
        for batch in slices(batches):
            coded = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = ["".join(decode(table, [c or []])) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {text} string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, hash of the ids and hash of the text decoded from them.

    Ids are hashed and decoded as they are emitted, so no row's token list is held whole.
    Null text counts as empty. Repeated rows stay repeated; an empty table gives no rows.
    """

    def digest(table: MergeTable, words: Words, names: dict[int, str], value: str) -> tuple[int, str, str]:
        n, of_ids, of_text, state = 0, hashlib.sha256(), hashlib.sha256(), Utf8()
        for ids in encode(table, words, chunked(value)):
            if ids:
                listed = ",".join(map(names.__getitem__, ids))
                of_ids.update((("," if n else "") + listed).encode())
                of_text.update(state.feed(b"".join(map(table.spelled.__getitem__, ids))).encode())
                n += len(ids)
        of_text.update(state.feed(b"", last=True).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches):
        table, words, names = load(path)
        for batch in slices(batches):
            found = [digest(table, words, names, t or "") for t in batch.column(1).to_pylist()]
            n, ids, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
