"""Token counts of every prefix of a text, by prefix dynamic programming.

One token alone can end a valid byte-level BPE encoding of a byte prefix (see
``byte_bpe``), so the count of a prefix is the count of the prefix before that token, plus
one.  The table of a text holds

- per piece of the split, the count of everything up to its end, and
- within a piece, the count of each of its byte prefixes, which pieces that begin alike
  share.

``count(k)`` (tokens of the first k characters) and ``longest(budget)`` (the longest
beginning of at most so many tokens) are read off that table; no text is encoded again.  A
cut can change the split before it in three places, which the table knows of: inside a
contraction, after the first space that follows other white space, and inside the string
of an added token.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.llm.byte_bpe import PATTERN, Splitter, Vocabulary
from basinlens.llm.common import per_process

CACHED_PIECES = 300_000  # counts of pieces that a worker process keeps, per generation (two are kept)
CACHED_PREFIXES = 300_000  # entries of prefixes that several pieces may share
SHORT = 64  # bytes; longer pieces are not kept
_COUNT = 1 << 32  # an entry is count * _COUNT + token


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others moved up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges(Vocabulary):
    """A vocabulary whose merges are listed pairs: no other pair of tokens joins."""

    def __init__(self, pairs: Sequence[tuple[bytes, bytes]]):
        ranks = {bytes([b]): b for b in range(256)}
        for place, (a, b) in enumerate(pairs):
            ranks.setdefault(a + b, 256 + place)
        self.pairs: dict[int, dict[int, int]] = {}
        halves: dict[int, tuple[int, int] | None] = dict.fromkeys(range(256))
        for a, b in pairs:
            self.pairs.setdefault(ranks[a], {}).setdefault(ranks[b], ranks[a + b])
            halves.setdefault(ranks[a + b], (ranks[a], ranks[b]))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.base = max(ranks.values()) + 1
        self.ranks = {t: r for t, r in ranks.items() if len(t) == 1 or self._merged(t) == halves[r]}
        self._keep_halves(halves)

    def _merged(self, token: bytes) -> tuple[int, ...]:
        """What is left of the token's bytes before the last merge."""
        parts = list(token)
        while len(parts) > 2:
            merges = [(self.pairs.get(a, {}).get(b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(merges)
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [rank]
        return tuple(parts)


class Definition:
    """What counting needs of a tokenizer file of the ``tokenizers`` library; byte-level BPE only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        odd = model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = whole.get("added_tokens") or []
        if not plain or odd or whole.get("normalizer") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer, prefix space, dropout or trimming added tokens")
        symbols = byte_symbols()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([tuple(bytes(symbols[c] for c in part) for part in pair) for pair in pairs])
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)


class TextCounts:
    """The table of one text."""

    __slots__ = ("counter", "text", "ends", "totals", "added")

    def __init__(self, counter: Counter, text: str, ends: list[int], totals: list[int], added: frozenset[int]):
        self.counter, self.text, self.added = counter, text, added
        self.ends, self.totals = ends, totals  # characters and tokens up to the end of each piece

    @property
    def total(self) -> int:
        return self.totals[-1] if self.totals else 0

    def _piece(self, at: int) -> tuple[int, int, int]:
        """(start, end, tokens before) of a piece."""
        return (self.ends[at - 1], self.ends[at], self.totals[at - 1]) if at else (0, self.ends[0], 0)

    def _resplit(self, at: int, upto: int) -> int:
        """Tokens up to ``upto`` in piece ``at``, where the split from the piece before it on may differ from the text's.

        Only pieces next to the cut are looked at, and their counts come from the table.
        """
        first = at
        while first and first > at - 2 and first - 1 not in self.added:
            first -= 1
        start, _, before = self._piece(first)
        return before + sum(map(self.counter.piece, self.counter.splitter.split(self.text[start:upto])))

    def _moves(self, at: int) -> bool:
        """Whether the first character of the piece would lie in one piece with white space before it, if the text ended there."""
        start = self.ends[at - 1] if at else 0
        return bool(at) and at not in self.added and at - 1 not in self.added and self.text[start].isspace() and self.text[start - 1].isspace()

    def _odd(self, at: int) -> bool:
        """Pieces whose beginnings are not all pieces: contractions and added tokens."""
        start, end, _ = self._piece(at)
        return at in self.added or (self.text[start] == "'" and self.text[start + 1 : end].isalpha())

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters, encoded alone."""
        if not 0 <= chars <= len(self.text):
            raise ValueError(f"not within the text: {chars}")
        if not chars:
            return 0
        at = bisect_left(self.ends, chars)
        start, end, before = self._piece(at)
        if chars == start + 1 and self._moves(at):
            return self._resplit(at, chars)
        if chars == end:
            return self.totals[at]
        if self._odd(at):
            return self._resplit(at, chars)
        inside = self.counter.prefixes_of(self.text[start:end])
        return before + int(inside[len(self.text[start:chars].encode()) - 1])

    def longest(self, budget: int) -> int:
        """Characters of the longest beginning that is at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        if budget <= 0:
            return 0
        # every piece has at least one token, so no cut beyond the piece after this one can do
        at = bisect_left(self.totals, budget)
        for near in range(min(at + 1, len(self.ends) - 1), at - 1, -1):
            start, end, before = self._piece(near)
            if self._odd(near):
                for chars in range(end, start, -1):
                    if self.count(chars) <= budget:
                        return chars
            elif before < budget:
                inside = self.counter.prefixes_of(self.text[start:end])[self._char_ends(start, end)]
                fit = np.flatnonzero(inside <= budget - before)
                # where the first character moves into the piece before, its own entry does not count
                fit = fit[fit > 0] if self._moves(near) else fit
                if len(fit):
                    return start + int(fit[-1]) + 1
            if self._moves(near) and self.count(start + 1) <= budget:
                return start + 1
        return self.ends[at - 1] if at else 0

    def _char_ends(self, start: int, end: int) -> np.ndarray:
        """Places of the last bytes of the characters start:end."""
        data = np.frombuffer(self.text[start:end].encode(), dtype=np.uint8)
        return np.append(np.flatnonzero((data & 0xC0) != 0x80)[1:], len(data)) - 1

    def table(self) -> np.ndarray:
        """The count of every prefix, by characters: entry k - 1 is ``count(k)``."""
        out = np.empty(len(self.text), dtype=np.int32)
        for at in range(len(self.ends)):
            start, end, before = self._piece(at)
            if self._odd(at):
                out[start:end] = [self.count(c) for c in range(start + 1, end + 1)]
            else:
                out[start:end] = before + self.counter.prefixes_of(self.text[start:end])[self._char_ends(start, end)]
                if self._moves(at):
                    out[start] = self.count(start + 1)
        return out


class Counter:
    """Counts texts; counts of recent pieces and of shared prefixes are kept, within fixed sizes."""

    def __init__(self, merges: Merges, added: Sequence[str] = ()):
        self.merges = merges
        self.splitter = Splitter(PATTERN, PATTERN)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.shared: dict[bytes, int] = {}
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _entries(self, data: bytes) -> list[int]:
        """count and last token of every byte prefix."""
        voc, shared = self.merges, self.shared
        ranks, beside, base, fit, longest = voc.ranks, voc.beside, voc.base, voc.fit, voc.longest
        if len(shared) >= CACHED_PREFIXES:
            shared.clear()
        out: list[int] = []
        if len(data) <= SHORT:
            while len(out) < len(data) and (entry := shared.get(data[: len(out) + 1])) is not None:
                out.append(entry)
        for end in range(len(out) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if start:
                    entry = out[start - 1]
                    before = entry % _COUNT
                    apart = beside.get(before * base + token)
                    if not (fit(before, token) if apart is None else apart):
                        continue
                    out.append(entry - before + _COUNT + token)
                else:
                    out.append(_COUNT + token)
                break
            if len(data) <= SHORT:
                shared[data[:end]] = out[-1]
        return out

    def prefixes_of(self, piece: str) -> np.ndarray:
        """Tokens of every byte prefix of a piece."""
        return np.array(self._entries(piece.encode()), dtype=np.int64) // _COUNT

    def piece(self, piece: str) -> int:
        """Tokens of one piece."""
        found = self.recent.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self._entries(piece.encode())[-1] // _COUNT
            if len(piece) <= SHORT:
                if len(self.recent) >= CACHED_PIECES:
                    self.recent, self.older = {}, self.recent
                self.recent[piece] = found
        return found

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for match in self.added.finditer(text) if self.added else ():
            yield text[at : match.start()], False
            yield match.group(), True
            at = match.end()
        yield text[at:], False

    def counts(self, text: str) -> TextCounts:
        pieces: list[str] = []
        added: set[int] = set()
        for segment, whole in self._segments(text):
            if whole:
                added.add(len(pieces))
                pieces.append(segment)
            elif segment:
                pieces += self.splitter.split(segment)
        found = list(map(self.recent.get, pieces))
        if None in found or added:
            found = [1 if i in added else self.piece(p) if n is None else n for i, (p, n) in enumerate(zip(pieces, found, strict=True))]
        return TextCounts(self, text, list(accumulate(map(len, pieces))), list(accumulate(found)), frozenset(added))


def _counter(definition, name: str) -> Counter:
    return per_process(f"token_counts {name}", lambda: Counter(definition.value.merges, definition.value.added))


def _count(batches: Iterator[pa.RecordBatch], definition, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = _counter(definition, name)
    for batch in batches:
        n_bytes, n_tokens, fits = [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            counts = counter.counts(text)
            n_bytes.append(len(text.encode()))
            n_tokens.append(counts.total)
            fits.append(counts.longest(limit))
        over = [n > limit for n in n_tokens]
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fits, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *made], ["key", "n_bytes", "n_tokens", "over_limit", "chars_within"])


def _table(batches: Iterator[pa.RecordBatch], definition, name: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(definition, name)
    for batch in batches:
        for at, value in enumerate(batch.column("text")):
            counts = pa.array([counter.counts(value.as_py() or "").table()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, 1), counts], ["key", "prefix_tokens"])


def _source(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source, source.schema["key"].dataType.simpleString()


def count_tokens(docs: DataFrame, file: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, chars_within) of every row's whole text.

    ``over_limit`` says whether it has more than ``limit`` tokens, ``chars_within`` how many
    characters its longest beginning of at most ``limit`` tokens has.  Strings of added
    tokens within a text are those tokens, as in the library's own call.  A null or empty
    text has no bytes and no tokens.  Null keys, repeated rows and an empty table come
    through as they are; other columns are ignored.  Very long texts: time is linear in the
    bytes, memory a few numbers per piece.  One pass without a shuffle; the vocabulary, whose
    size does not depend on the data, is read by the driver and broadcast.
    """
    source, kind = _source(docs, key, text)
    definition = docs.sparkSession.sparkContext.broadcast(Definition(file))
    schema = f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within bigint"
    return source.mapInArrow(partial(_count, definition=definition, name=file, limit=limit), schema).withColumnRenamed("key", key)


def prefix_tokens(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, prefix_tokens array<int>): the token count of every beginning of every text, by characters.

    Written once, the table answers later questions with column expressions:
    ``element_at(prefix_tokens, k)`` is the count of the first k characters, and
    ``within(prefix_tokens, budget)`` the longest beginning within a budget.  Null and empty
    texts have an empty array.  A task holds one text's array at a time.
    """
    source, kind = _source(docs, key, text)
    definition = docs.sparkSession.sparkContext.broadcast(Definition(file))
    made = source.mapInArrow(partial(_table, definition=definition, name=file), f"key {kind}, prefix_tokens array<int>")
    return made.withColumnRenamed("key", key)


def within(prefix_tokens, budget):
    """Column: characters of the longest beginning of at most ``budget`` tokens, from a ``prefix_tokens`` array.

    Counts do not only rise (a longer beginning may merge into fewer tokens), so the last
    entry within the budget counts, not the first one beyond it.
    """
    budget = budget if not isinstance(budget, int) else F.lit(budget)
    fit = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fit), F.lit(0))
