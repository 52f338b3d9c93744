"""Byte-level BPE encoding by prefix dynamic programming.

For every prefix of a piece's bytes one token alone can end a valid encoding of that
prefix.  Storing it per prefix gives the encoding of every prefix at once: walk back from
the end, token by token.  The last token of prefix i is the vocabulary entry that ends
there, whose start is a prefix whose last token may stand beside it.  Two tokens may stand
side by side when merging their joint bytes would not join anything across the border.
Appending only adds prefixes; after an edit the old entries hold again as soon as a token's
greatest length of them came out as before.  Time is linear in the bytes, also for very
long runs without a break.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import per_process

# A worker process keeps about 100 MB of these when they are full, beside 40 MB of vocabulary; an executor runs several workers.
CACHED_PIECES = 150_000  # encodings of pieces, per generation (two are kept)
CACHED_PREFIXES = 100_000  # last tokens of prefixes that several pieces may share
CACHED_PAIRS = 250_000
SHORT = (2, 1)  # lengths of tokens that need no look at how they end


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Merge ranks, and what decides whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        # lengths of the tokens that end in three given bytes, longest first: no other ones need a look
        endings: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                endings.setdefault(token[-3:], {1, 2}).add(len(token))
        same = {lengths: lengths for lengths in map(self._descending, endings.values())}
        self.lengths = {ending: same[self._descending(lengths)] for ending, lengths in endings.items()}
        self.base = max(ranks.values()) + 1
        halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            halves[rank] = self._halves(token, ranks)
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs.setdefault(left, {})[right] = rank
        # tokens that merging their own bytes yields; no others can occur
        self.ranks = {t: r for t, r in ranks.items() if len(t) == 1 or halves[r] is not None}
        self._keep_halves(halves)

    def _keep_halves(self, halves: dict[int, tuple[int, int] | None]) -> None:
        """What ``fit`` needs: each merged token's outer halves, whose chain leads to what lies at its edge while it is merged."""
        self.last_half = {r: both[1] for r, both in halves.items() if both}
        self.first_half = {r: both[0] for r, both in halves.items() if both}
        self.beside: dict[int, bool] = {}

    @staticmethod
    def _descending(lengths: set[int]) -> tuple[int, ...]:
        return tuple(sorted(lengths, reverse=True))

    @staticmethod
    def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two parts whose merge makes the token, or None if its bytes merge into something else."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 62:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge across the border comes before its two parts merge otherwise.

        Of equal ranks the leftmost merge comes first: a merge inside ``a`` goes before one
        across, and one across before a merge inside ``b``.
        """
        key = a * self.base + b
        known = self.beside.get(key)
        if known is None:
            known, x, ends = True, a, 1 << 62  # the merge of rank ``ends`` takes x into what follows it in the chain
            while known and x is not None:
                merges = self.pairs.get(x)
                y, follows = b, 1 << 62
                while merges is not None and y is not None:
                    if (rank := merges.get(y)) is not None and rank < ends and rank <= follows:
                        known = False
                        break
                    y, follows = self.first_half.get(y), y
                x, ends = self.last_half.get(x), x
            if len(self.beside) >= CACHED_PAIRS:
                self.beside.clear()
            self.beside[key] = known
        return known


class PrefixEncoding:
    """The last token of every prefix of ``data``."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Entries of earlier prefixes stay as they are."""
        self.data += more
        self._extend(len(self.data))

    def _extend(self, until: int) -> None:
        voc, data, last = self.vocabulary, self.data, self.last
        ranks, beside, base, fit, lengths = voc.ranks, voc.beside, voc.base, voc.fit, voc.lengths
        for end in range(len(last) + 1, until + 1):
            for length in lengths.get(data[max(0, end - 3) : end], SHORT):
                start = end - length
                token = ranks.get(data[start:end]) if start >= 0 else None
                if token is None:
                    continue
                if start == 0:
                    last.append(token)
                    break
                before = last[start - 1]
                known = beside.get(before * base + token)
                if known or (known is None and fit(before, token)):
                    last.append(token)
                    break

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; returns how many entries were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        same = 0
        while len(self.last) < len(self.data):
            self._extend(len(self.last) + 1)
            at = len(self.last) - 1
            # an entry looks back no further than the longest token
            same = same + 1 if at >= start + len(new) and old[at - shift] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                return at + 1 - start
        return len(self.last) - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (of all by default)."""
        out = []
        at = len(self.data) if end is None else end
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Splitter:
    """Matches of the split pattern.

    The pattern's classes need the ``regex`` module; for texts without the characters on
    which the standard module's classes differ, an equal pattern of that module is several
    times as fast.
    """

    def __init__(self, pattern: str, known_pattern: str | None):
        self.exact = regex.compile(pattern)
        self.plain = None
        if pattern == known_pattern:
            self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
            every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
            odd: set[str] = set()
            for ours, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
                odd ^= set(re.findall(ours, every)) ^ set(regex.findall(theirs, every))
            self.odd = frozenset(odd)

    def split(self, text: str) -> list[str]:
        if self.plain is None or not self.odd.isdisjoint(set(text)):
            return self.exact.findall(text)
        return self.plain.findall(text)


#: The split pattern of the public byte-level vocabularies, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encodes texts piece by piece; encodings of recent pieces are kept in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.vocabulary = Vocabulary(ranks)
        self.splitter = Splitter(pattern, PATTERN)
        self.prefixes: dict[bytes, int] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        found = self.older.get(piece)
        if found is None:
            data = piece.encode()
            token = self.vocabulary.ranks.get(data)
            if token is not None:
                ids = [token]
            elif len(data) > 64:
                ids = PrefixEncoding(self.vocabulary, data).ids()
            else:
                ids = self._short(data)
            found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(piece) <= 64:
            if len(self.recent) >= CACHED_PIECES:
                self.recent, self.older = {}, self.recent
            self.recent[piece] = found
        return found

    def _short(self, data: bytes) -> list[int]:
        """Pieces that begin alike share the entries of their common prefixes."""
        prefixes, voc = self.prefixes, self.vocabulary
        ranks, beside, base, fit, lengths = voc.ranks, voc.beside, voc.base, voc.fit, voc.lengths
        if len(prefixes) >= CACHED_PREFIXES:
            prefixes.clear()
        size = known = len(data)
        while known and data[:known] not in prefixes:
            known -= 1
        for end in range(known + 1, size + 1):
            for length in lengths.get(data[max(0, end - 3) : end], SHORT):
                start = end - length
                token = ranks.get(data[start:end]) if start >= 0 else None
                if token is None:
                    continue
                if start:
                    before = prefixes[data[:start]]
                    apart = beside.get(before * base + token)
                    if not (fit(before, token) if apart is None else apart):
                        continue
                prefixes[data[:end]] = token
                break
        out = []
        while size:
            token = prefixes[data[:size]]
            out.append(token)
            size -= len(voc.tokens[token])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        get, piece = self.recent.get, self.piece
        out = []
        for p in self.splitter.split(text):
            found = get(p)
            if found is None:
                found = piece(p)
                get = self.recent.get  # the generations may have moved on
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class EncodedText:
    """An encoded text that can be appended to and edited; only pieces near a change are encoded again."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec = codec
        self.pieces = codec.splitter.split(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        codec = self.codec
        return np.frombuffer(b"".join(codec.recent.get(p) or codec.piece(p) for p in self.pieces), dtype="<u4").tolist()

    def append(self, more: str) -> None:
        """The last piece alone can change: all others were ended by a character that stays."""
        tail = self.pieces.pop() if self.pieces else ""
        self.pieces += self.codec.splitter.split(tail + more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of the characters start:stop."""
        first, at = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) < start:
            at += len(self.pieces[first])
            first += 1
        if first:  # a match looks one character ahead
            first -= 1
            at -= len(self.pieces[first])
        last, end = first, at
        while last < len(self.pieces) and end < stop:
            end += len(self.pieces[last])
            last += 1
        middle = "".join(self.pieces[first:last])
        middle = middle[: start - at] + new + middle[stop - at :]
        while True:
            # take in pieces until the split ends where an old piece ended, with one piece to spare
            more = self.pieces[last : last + 2]
            split = self.codec.splitter.split(middle + "".join(more))
            if split[-len(more) :] == more or last >= len(self.pieces):
                self.pieces[first : last + len(more)] = split
                return
            middle += "".join(more)
            last += len(more)


def _encode(batches: Iterator[pa.RecordBatch], ranks, pattern: str, name: str) -> Iterator[pa.RecordBatch]:
    codec = per_process(f"byte_bpe {name}", lambda: Codec(ranks.value, pattern))
    for batch in batches:
        counts, id_hashes, text_hashes = [], [], []
        for text in batch.column("text"):
            ids = codec.encode(text.as_py() or "")
            counts.append(len(ids) // 4)
            id_hashes.append(hashlib.sha256(ids).hexdigest())
            text_hashes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        kept = [n for n in batch.schema.names if n != "text"]
        digests = [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *digests], [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def token_digests(
    docs: DataFrame, rank_file: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep..., n_tokens, ids_sha256, decoded_sha256) per row of ``docs``: encode each whole text, decode it again.

    One pass without a shuffle; a task holds one batch of texts.  A null text counts as
    empty (no ids).  Null keys, repeated rows and an empty table come through as they are;
    other columns are ignored.  The ranks are read by the driver and broadcast: their size
    is the vocabulary's, whatever the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    kept = [F.col(c) for c in (key, *keep)]
    source = docs.select(*kept, F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(
        partial(_encode, ranks=ranks, pattern=pattern, name=f"{rank_file} {pattern}"),
        f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _ids(batches: Iterator[pa.RecordBatch], ranks, pattern: str, name: str, column: str) -> Iterator[pa.RecordBatch]:
    codec = per_process(f"byte_bpe {name}", lambda: Codec(ranks.value, pattern))
    for batch in batches:
        ids = [np.frombuffer(codec.encode(t.as_py() or ""), dtype="<u4").astype(np.int32) for t in batch.column("_text")]
        at = batch.schema.get_field_index("_text")
        yield batch.remove_column(at).append_column(column, pa.array(ids, pa.list_(pa.int32())))


def with_token_ids(docs: DataFrame, rank_file: str, pattern: str = PATTERN, text: str = "text", column: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text`` as an array of int; a column named like it is replaced."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    source = docs.drop(column, "_text").withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(
        partial(_ids, ranks=ranks, pattern=pattern, name=f"{rank_file} {pattern}", column=column), f"{fields}, `{column}` array<int>"
    )
