"""Alignment of two tokenizers' tokens, with corpus-wide counts by external spill counting.

Token pairs whose byte ranges overlap are linked.  How often a pair is linked in the whole
corpus, and which pairs are their B id's most frequent, takes every link of every document:

1. **Runs.**  A task encodes documents and keeps (B id, A id, document, times) records
   until a bound, then spills them as one zstd run in side-major order (B id, A id): the
   records of a pair are one head (the pair and its links in the run) and a body
   (documents and times).  Heads are cut by the radix of their B id.
2. **Counting.**  A radix's runs of heads meet in k-way heap merges, at most about ``FAN``
   runs at a time, until one run is left.  It is B-major, so each B id's highest count is
   known when its heads end.
3. **Contributions.**  Each run's heads meet the counts of their radix; what streams back
   to the run is a count and a mark (highest or not) per head, in the run's order.  The
   run's body turns them into sums per document.

Heads are summed before any shuffle, so a pair that every document holds costs a record
per run and task.  The runs are a written table in the shared folder: lost executors take
none with them.

Documents are encoded chunk by chunk, where a chunk begins at white space or at punctuation
after a letter, if the vocabularies allow (else a text is one chunk).  No token crosses
such a border, and links within a chunk are found once per worker process and distinct
chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import per_process, stream_groups, written
from basinlens.llm.token_counts import byte_symbols

CACHED_CHUNKS = 250_000  # alignments of chunks that a worker process keeps
CACHED_CHARS = 8_000_000  # and their characters
RUN_DOCUMENTS = 4096
RUN_CHARS = 3_000_000  # about 1.5 million links; a single longer document is a run of its own
RADIX = 128  # parts of the B ids
FAN = 64  # runs that a merge reads, on average at most
SPREAD = 256  # runs that meet one copy of a radix's counts


def links_of(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[int, str, list[int]]:
    """(groups, groups as text, links as B * 2**32 + A) of two token lists over the same bytes."""
    n_a, n_b = len(a), len(b)
    if n_a == 1 or n_b == 1:  # one group
        return 1, f"{','.join(map(str, a))}|{','.join(map(str, b))}", [y << 32 | x for y in b for x in a]
    groups, links, i, j, first_a, first_b, end_a, end_b = [], [], 0, 0, 0, 0, len(a_bytes[0]), len(b_bytes[0])
    while True:
        links.append(b[j] << 32 | a[i])
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{a[i - 1]}|{b[j - 1]}" if i - first_a == j - first_b == 1 else f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
            first_a, first_b = i, j
            if i == n_a:
                return len(groups), ";".join(groups), links
            end_a, end_b = end_a + len(a_bytes[i]), end_b + len(b_bytes[j])
        elif end_a < end_b:
            i += 1
            end_a += len(a_bytes[i])
        else:
            j += 1
            end_b += len(b_bytes[j])


class Aligner:
    """Both tokenizers on chunks; the second puts a space before each text, so texts begin with one here."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(definition)
        self.first.encode_special_tokens = True  # their strings within a text are ordinary text
        whole = json.loads(definition)
        symbols = byte_symbols()
        added = {t["content"] for t in whole.get("added_tokens") or []}
        self.first_bytes = {i: bytes(map(symbols.__getitem__, t)) for t, i in whole["model"]["vocab"].items() if t not in added}
        self.second = SentencePieceProcessor(model_proto=model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = self.second.piece_to_id("▁")
        byte_level = (whole.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not whole.get("normalizer")
        self.chunks = re.compile(self._chunk_pattern(pieces) if byte_level else r"[\s\S]+")
        self._clear()

    def _chunk_pattern(self, pieces: list[str]) -> str:
        """Chunks begin where no piece of either side can lie across: at white space, and at punctuation after a letter."""
        beside = {two for i, p in enumerate(pieces) if not self.second.is_byte(i) and not self.second.is_control(i) for two in pairwise(p.replace("▁", " "))}
        joined = {c for two in beside for c in two}
        inner = "".join(sorted(c for c in joined - {" "} if c.isspace()))
        if "\n" in joined or len(self.second.encode("\n")) != 2 or any(b == " " and a != " " for a, b in beside):
            return r"[\s\S]+"
        letters = [chr(c) for c in range(0x41, 0x530) if unicodedata.category(chr(c))[0] == "L"]
        marks = [m for m in string.punctuation if m != "_" and not any((c, m) in beside for c in letters)]
        letter, mark = f"[{''.join(letters)}]", f"[{re.escape(''.join(marks))}]"
        more = rf"|[{re.escape(inner)}]\s*" if inner else ""
        return rf"\s*\S(?:[^\s{mark[1:-1]}]+|(?<!{letter}){mark}{more})*|\s+"

    def _clear(self) -> None:
        # kept chunks: plain values in few containers, which the garbage collector need not walk
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = array("q")  # A tokens, B tokens, groups, links of each chunk
        self.links = array("q")  # of all chunks, one after another
        self.inexact: set[int] = set()
        self.chars = 0

    def _add(self, chunks: list[str]) -> None:
        first = self.first.encode_batch_fast(chunks, add_special_tokens=False)
        # the library puts a space before each: a chunk has one, or the pieces of the space and of a line end are taken off again
        second = self.second.encode([c[1:] if c[0] == " " else f"\n{c}" for c in chunks], num_threads=1)
        for chunk, one, b in zip(chunks, first, second, strict=True):
            a = one.ids
            if chunk[0] != " ":
                b = b[2:]
            elif len(chunk) == 1:
                b = [self.space]
            a_bytes, b_bytes = [self.first_bytes[i] for i in a], [self.second_bytes[i] for i in b]
            source = chunk.encode()
            found = 0, "", []
            if b"".join(a_bytes) == source and b"".join(b_bytes) == source:
                found = links_of(a, b, a_bytes, b_bytes)
            else:
                self.inexact.add(len(self.texts))
            self.known[chunk] = len(self.texts)
            self.texts.append(found[1])
            self.sizes.extend((len(a), len(b), found[0], len(found[2])))
            self.links.extend(found[2])

    def numbers(self, text: str) -> list[int]:
        """The text's chunks by their number among those kept."""
        chunks = self.chunks.findall(" " + text)
        found = list(map(self.known.get, chunks))
        if None in found:
            new = list(dict.fromkeys([c for c, number in zip(chunks, found, strict=True) if number is None]))
            for at in range(0, len(new), 1000):
                self._add(new[at : at + 1000])
            self.chars += sum(map(len, new))
            found = list(map(self.known.__getitem__, chunks))
        return found

    def full(self) -> bool:
        return len(self.texts) > CACHED_CHUNKS or self.chars > CACHED_CHARS

    def forget(self, kept: np.ndarray) -> None:
        """Let go of all chunks but ``kept`` (ascending).  Only between runs: a run's documents are numbers of chunks."""
        chunks, texts, sizes, links, inexact = list(self.known), self.texts, np.array(self.sizes).reshape(-1, 4), np.array(self.links), self.inexact
        self._clear()
        self.sizes.frombytes(sizes[kept].tobytes())
        self.links.frombytes(links[_spans(sizes[:, 3], kept)].tobytes())
        for new, old in enumerate(kept.tolist()):
            self.known[chunks[old]] = new
            self.texts.append(texts[old])
            if old in inexact:
                self.inexact.add(new)
        self.chars = sum(map(len, self.known))


def _spans(sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the values of ``rows``, where row i has ``sizes[i]`` values and they lie one after another."""
    starts, held = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    return np.repeat(starts - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd block: their lengths, then their bytes."""
    head = np.array([len(arrays), *map(len, arrays), *(a.dtype.itemsize for a in arrays)], dtype="<i8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpacked(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8).tolist()
    out, at = [], 8 * (2 * n + 1)
    for size, width in zip(head[:n], head[n:], strict=True):
        out.append(np.frombuffer(data, f"<i{width}", size, at))
        at += size * width
    return out


class Run:
    """Documents of a task until they are spilled."""

    def __init__(self):
        self.keys: list = []
        self.digests: list[str] = []
        self.chunks: list[np.ndarray] = []
        self.frequent = np.zeros(0, dtype=np.int64)  # chunks that occur more than once, known when the run is spilled
        self.chars = 0

    def add(self, aligner: Aligner, key, text: str) -> None:
        numbers = aligner.numbers(text) if text else []
        if not aligner.inexact.isdisjoint(numbers):
            numbers = []
        self.keys.append(key)
        self.digests.append(hashlib.sha256(";".join(map(aligner.texts.__getitem__, numbers)).encode()).hexdigest() if numbers else "")
        self.chunks.append(np.array(numbers, dtype=np.int64))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= RUN_CHARS or len(self.keys) >= RUN_DOCUMENTS

    def records(self, aligner: Aligner) -> tuple[np.ndarray, ...]:
        """(sizes of documents, pairs, records of each, documents, times): pairs by radix, B id, A id; their records by document."""
        held = np.array([len(c) for c in self.chunks])
        docs = np.repeat(np.arange(len(self.chunks)), held)
        chunks, place, uses = np.unique(np.concatenate([np.zeros(0, np.int64), *self.chunks]), return_inverse=True, return_counts=True)
        self.frequent = chunks[uses > 1]
        every = np.array(aligner.sizes).reshape(-1, 4)
        sizes = every[chunks]
        totals = np.zeros((len(self.chunks), 4), dtype=np.int64)
        totals[held > 0] = np.add.reduceat(sizes[place], (np.cumsum(held) - held)[held > 0], axis=0) if len(docs) else 0
        where, times = np.unique(docs * max(1, len(chunks)) + place, return_counts=True)
        docs, place = np.divmod(where, max(1, len(chunks)))
        flat = np.array(aligner.links)[_spans(every[:, 3], chunks)]
        sizes = sizes[:, 3]
        pairs, pair = np.unique(flat, return_inverse=True)
        order = np.lexsort((pairs, (pairs >> 32) % RADIX))
        pairs = pairs[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        pair = rank[pair]
        # every (document, chunk) yields the links of its chunk
        per = sizes[place]
        width = max(1, len(self.chunks))
        keys = pair[_spans(sizes, place)] * width + np.repeat(docs, per)
        order = np.argsort(keys)
        keys, times = keys[order], np.repeat(times, per)[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(keys) else times
        pair, docs = np.divmod(keys[first], width)
        return totals, pairs, np.bincount(pair, minlength=len(pairs)), docs, times

    def spilled(self, aligner: Aligner, name: int, kind: pa.DataType) -> pa.RecordBatch:
        """The row of the documents and their body, then a row of heads per radix."""
        totals, pairs, sizes, docs, times = self.records(aligner)
        starts = np.cumsum(sizes) - sizes
        counts = np.add.reduceat(times, starts) if len(pairs) else np.zeros(0, np.int64)
        # documents as steps within a pair: small numbers pack well
        steps = np.diff(docs, prepend=0)
        steps[starts] = docs[starts]
        radix = (pairs >> 32) % RADIX
        cuts = np.flatnonzero(np.append(True, radix[1:] != radix[:-1])).tolist() if len(pairs) else []
        heads = [_packed(pairs[a:b].astype("<i8"), counts[a:b].astype("<i8")) for a, b in pairwise([*cuts, len(pairs)])]
        body = _packed(sizes.astype("<i4"), steps.astype("<i4"), times.astype("<i4"))
        columns = [self.keys, *totals.T.tolist(), self.digests]
        lists = [pa.array([c] + [None] * len(heads), pa.list_(t)) for c, t in zip(columns, [kind, *[pa.int64()] * 4, pa.string()], strict=True)]
        names = [pa.array([name] * (len(heads) + 1), pa.int64()), pa.array([-1, *radix[cuts].tolist()], pa.int32())]
        blocks = [pa.array([None, *heads], pa.binary()), pa.array([body] + [None] * len(heads), pa.binary())]
        return pa.RecordBatch.from_arrays([*names, *blocks, *lists], _RUN)


_DIGEST = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_RUN = ["run", "radix", "heads", "body", *_DIGEST]


def _runs(batches: Iterator[pa.RecordBatch], files, name: str) -> Iterator[pa.RecordBatch]:
    aligner = per_process(f"alignment {name}", lambda: Aligner(*files.value))
    number, run, kind = TaskContext.get().partitionId() << 32, Run(), None
    for batch in batches:
        kind = batch.schema.field("key").type
        for key, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            run.add(aligner, key, value.as_py() or "")
            if run.full():
                yield run.spilled(aligner, number, kind)
                if aligner.full():
                    aligner.forget(run.frequent)
                number, run = number + 1, Run()
    if run.keys:
        yield run.spilled(aligner, number, kind)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of heads in place of a group's: a heap of the runs' next heads, equal pairs added up."""
    for (radix, slot), group in stream_groups(batches, ["radix", "slot"]):
        runs = [_unpacked(block.as_py()) for block in group.column("heads")]
        pairs: list[int] = []
        counts: list[int] = []
        last = None
        for pair, count in heapq.merge(*(zip(p.tolist(), c.tolist(), strict=True) for p, c in runs), key=lambda head: head[0]):
            if pair == last:
                counts[-1] += count
            else:
                pairs.append(pair)
                counts.append(count)
                last = pair
        block = _packed(np.array(pairs, "<i8"), np.array(counts, "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([slot], pa.int64()), pa.array([block], pa.binary())], ["radix", "slot", "heads"])


def merged(heads: DataFrame, runs: int) -> DataFrame:
    """(radix, heads): all runs of a radix as one, merged about ``FAN`` at a time."""
    level = heads.select("radix", F.col("run").alias("slot"), "heads")
    while True:
        runs = -(-runs // FAN)
        dealt = level.withColumn("slot", F.pmod(F.xxhash64("slot"), F.lit(runs))).repartition("radix", "slot").sortWithinPartitions("radix", "slot")
        level = written(dealt.mapInArrow(_merge, "radix int, slot bigint, heads binary"), "merged-heads")
        if runs == 1:
            return level.select("radix", "heads")


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run's heads: the corpus-wide counts and whether they are the highest of their B id."""
    known = (None, None)
    for batch in batches:
        tags, radixes, parts, runs = (batch.column(c).to_pylist() for c in ("tag", "radix", "part", "run"))
        for at, (tag, radix, part, run) in enumerate(zip(tags, radixes, parts, runs, strict=True)):
            pairs, counts = _unpacked(batch.column("heads")[at].as_py())
            if tag == 0:  # comes first in its radix and part
                side = pairs >> 32
                starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
                highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(side))))
                known, table = (radix, part), (pairs, counts, counts == highest)
                continue
            if known != (radix, part):
                raise ValueError(f"no counts for radix {radix}")
            places = np.searchsorted(table[0], pairs)
            block = _packed(table[1][places], table[2][places].astype("<i1"))
            columns = [pa.array([run], pa.int64()), pa.array([radix], pa.int32()), pa.array([block], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["run", "radix", "answer"])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a run with the sums of their links' counts: the run's row, then its answers by radix."""

    def finished(row: pa.RecordBatch, answers: list[bytes]) -> pa.RecordBatch:
        columns = [row.column(c)[0].values for c in _DIGEST]
        sizes, steps, times = _unpacked(row.column("body")[0].as_py())
        parts = [_unpacked(a) for a in answers]
        counts = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        highest = np.concatenate([np.zeros(0, np.int8), *(p[1] for p in parts)])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        through = np.cumsum(steps, dtype=np.int64)
        docs = through - np.repeat(through[starts] - steps[starts], sizes) if len(sizes) else through
        best, total = (np.zeros(len(columns[0]), dtype=np.int64) for _ in range(2))
        np.add.at(best, docs, np.repeat(highest, sizes) * times.astype(np.int64))
        np.add.at(total, docs, np.repeat(counts, sizes) * times)
        sums = [pa.array(best), pa.array(total)]
        return pa.RecordBatch.from_arrays([*columns[:5], *sums, columns[5]], [*_DIGEST[:5], "n_best", "count_sum", _DIGEST[5]])

    row, name, answers = None, None, []
    for batch in batches:
        runs, radixes = batch.column("run").to_pylist(), batch.column("radix").to_pylist()
        for at, (run, radix) in enumerate(zip(runs, radixes, strict=True)):
            if radix < 0:  # comes first in its run
                if row is not None:
                    yield finished(row, answers)
                row, name, answers = batch.slice(at, 1), run, []
            elif run != name:
                raise ValueError(f"no documents for run {run}")
            else:
                answers.append(batch.column("answer")[at].as_py())
    if row is not None:
        yield finished(row, answers)


def align(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A is a byte-level BPE of the ``tokenizers`` library on a space and the text, B a
    ``sentencepiece`` model on the text.  A null or empty text, and one that the tokens of
    either do not give back, has zeros and an empty digest, and no part in the counts.  Null
    keys, repeated rows and an empty table come through as they are; other columns are
    ignored.  Ties: all pairs with a B id's highest count are its best.  A very long text is
    one run, of some 30 bytes a link.  The vocabularies, of a size that does not depend on
    the data, are read by the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as first, open(pieces, "rb") as second:
        files = spark.sparkContext.broadcast((first.read(), second.read()))
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    lists = ", ".join(f"{c} array<{t}>" for c, t in zip(_DIGEST, [kind, *["bigint"] * 4, "string"], strict=True))
    spill = source.mapInArrow(partial(_runs, files=files, name=f"{byte_level} {pieces}"), f"run bigint, radix int, heads binary, body binary, {lists}")
    runs = written(spill, "alignment-runs")
    heads = runs.where("radix >= 0").select("radix", "run", "heads")
    number = runs.where("radix < 0").count()
    counted = merged(heads, max(1, number))
    parts = -(-number // SPREAD) or 1
    asked = heads.select(F.lit(1).alias("tag"), "radix", F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int").alias("part"), "run", "heads")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    known = counted.select(F.lit(0).alias("tag"), "radix", copies, F.lit(None).cast("bigint").alias("run"), "heads")
    meet = known.unionByName(asked).repartition("radix", "part").sortWithinPartitions("radix", "part", "tag")
    answers = meet.mapInArrow(_answer, "run bigint, radix int, answer binary")
    rows = runs.where("radix < 0").select("run", "radix", F.lit(None).cast("binary").alias("answer"), "body", *_DIGEST)
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("body", *_DIGEST)]
    back = rows.unionByName(answers.select("run", "radix", "answer", *empty)).repartition("run").sortWithinPartitions("run", "radix")
    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return back.mapInArrow(_contribute, schema).withColumnRenamed("key", key)
