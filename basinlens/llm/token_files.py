"""Token ids in flat binary files, memory-mapped again for reading.

A folder holds shards in ascending document order; each shard has

- ``tokens-*``: ids one after another, little-endian unsigned, 16 bits where the
  vocabulary allows and else 32;
- ``offsets-*``: unsigned 64-bit starts of its documents in the whole corpus, and the end;
- ``docs-*``: the documents' 64-bit ids (a null id is the smallest integer);

and ``index`` (Parquet) lists the shards with their bases, which are prefix sums over the
shards before.  A shard's files get a name of their own per attempt and the index names
those of the attempt that succeeded, so a lost executor or a repeated task leaves no trace.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens.llm.byte_bpe import PATTERN, Splitter
from basinlens.llm.common import per_process
from basinlens.llm.token_counts import byte_symbols

CACHED_PIECES = 400_000  # as in byte_bpe
NULL_ID = -(1 << 63)
BATCH = 10_000  # documents per batch when reading


class RecentPieces(dict):
    """Ids of recent pieces; a piece that is not among them is looked up in the generation before, else encoded."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class PieceTokenizer:
    """Whole texts through the tokenizers library; where its pieces are independent, each recent piece only once, by its model alone."""

    def __init__(self, definition: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added_tokens  # else their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        model = json.loads(definition)
        before = model.get("pre_tokenizer") or {}
        alone = model["model"]["type"] == "BPE" and not model["model"].get("dropout") and not model.get("normalizer")
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.splitter = Splitter(PATTERN, PATTERN) if alone and byte_level else None
        contents = sorted({t["content"] for t in model.get("added_tokens") or [] if added_tokens or not t.get("special")}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.model = self.tokenizer.model
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.width = self.kind.itemsize
        self.recent = RecentPieces(self._piece, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.splitter is None:
            return [self._whole(t) for t in texts]
        if self.added is None:
            return [self._pieces(self.splitter.split(t)) for t in texts]
        # a text with an added token's string is not split as the pattern says
        return [self._whole(t) if self.added.search(t) else self._pieces(self.splitter.split(t)) for t in texts]

    def _piece(self, piece: str) -> bytes:
        """A piece through the library's model, its bytes as their symbols: nothing is split again."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))
        return b"".join([t.id.to_bytes(self.width, "little") for t in tokens])

    def _pieces(self, pieces: list[str]) -> bytes:
        if len(self.recent) >= CACHED_PIECES:
            self.recent.older = {}
            self.recent = RecentPieces(self._piece, self.recent)
        return b"".join(map(self.recent.__getitem__, pieces))


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if ":" not in folder.split("/", 1)[0]:
        return pa.fs.LocalFileSystem(), os.path.abspath(folder)
    return pa.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, definition, name: str, end_id: int, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = per_process(f"token_files {name} {added_tokens}", lambda: PieceTokenizer(definition.value, added_tokens))
    end = np.array([end_id], dtype=tokenizer.kind).tobytes()
    files, root = _place(folder)
    shard = TaskContext.get().partitionId()
    tag = f"{shard:07d}-{uuid.uuid4().hex}"
    sizes: list[int] = []
    ids: list[np.ndarray] = []
    out = None
    for batch in batches:
        if out is None:
            out = files.open_output_stream(f"{root}/tokens-{tag}")
        encoded = tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])
        for tokens in encoded:
            sizes.append(len(tokens) // tokenizer.kind.itemsize + 1)
            out.write(tokens)
            out.write(end)
        ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy())
    if out is None:
        return
    out.close()
    with files.open_output_stream(f"{root}/docs-{tag}") as to:
        to.write(np.concatenate(ids).astype("<i8").tobytes())
    with files.open_output_stream(f"{root}/sizes-{tag}") as to:
        to.write(np.array(sizes, dtype="<u8").tobytes())
    row = {"shard": [shard], "tag": [tag], "width": [tokenizer.kind.itemsize], "docs": [len(sizes)], "tokens": [sum(sizes)]}
    yield pa.RecordBatch.from_pydict(row, schema=_SHARDS)


_SHARDS = pa.schema([("shard", pa.int64()), ("tag", pa.string()), ("width", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _offsets(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write each shard's 64-bit offsets: the base of the shard plus the sizes of its documents so far."""
    files, root = _place(folder)
    for batch in batches:
        for row in batch.to_pylist():
            sizes = _mapped(files, f"{root}/sizes-{row['tag']}", "<u8")
            offsets = np.full(len(sizes) + 1, row["token_base"], dtype="<u8")
            offsets[1:] += np.cumsum(sizes, dtype=np.uint64)
            with files.open_output_stream(f"{root}/offsets-{row['tag']}") as to:
                to.write(offsets.tobytes())
        yield batch


def _mapped(files: pa.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A whole file as an array: memory-mapped where it is local, else read."""
    if isinstance(files, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", added_tokens: bool = False
) -> DataFrame:
    """Write the ids of every whole text, each document followed by ``end_id``; returns the index of shards.

    Documents are dealt by ranges of (key, text hash) - one shuffle of the texts - and each
    task writes one shard, so nothing is gathered; the driver sees one row per shard.  A null
    text gives the end id alone; null keys come first; repeated rows are all written; an
    empty table gives an index without shards.  Other columns are ignored.  The strings of
    special tokens are ordinary text; with ``added_tokens`` they give the tokens' ids, as in
    the library's own call.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # its size is the vocabulary's
    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = source.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    shards = ordered.drop("_tie").mapInArrow(
        partial(_write, folder=folder, definition=definition, name=tokenizer_file, end_id=end_id, added_tokens=added_tokens),
        "shard bigint, tag string, width bigint, docs bigint, tokens bigint",
    )
    shards.write.parquet(f"{folder}/shards")
    shards = spark.read.schema(shards.schema).parquet(f"{folder}/shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    based = shards.withColumns({f"{c[:-1]}_base": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("docs", "tokens")})
    index = _spread(based, shards.count()).mapInArrow(partial(_offsets, folder=folder), based.schema)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(based.schema).parquet(f"{folder}/index")


def _spread(index: DataFrame, shards: int) -> DataFrame:
    """One shard per task."""
    return index.repartition(max(1, shards))


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    files, root = _place(folder)
    for batch in batches:
        for row in batch.to_pylist():
            kind = "<u2" if row["width"] == 2 else "<u4"
            tokens, offsets, docs = (
                _mapped(files, f"{root}/{name}-{row['tag']}", k) for name, k in (("tokens", kind), ("offsets", "<u8"), ("docs", "<i8"))
            )
            for at in range(0, len(docs), BATCH):
                ids = np.asarray(docs[at : at + BATCH])
                bounds = np.asarray(offsets[at : at + len(ids) + 1]).astype(np.int64)
                places = (bounds - row["token_base"]).tolist()
                parts = [np.asarray(tokens[a:b]).astype("<u4") for a, b in zip(places[:-1], places[1:], strict=True)]
                columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(bounds[:-1]), pa.array(np.diff(bounds))]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                else:
                    columns.append(pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens) and the ids (or their crc32) per document, from the files of ``folder``."""
    index = spark.read.parquet(f"{folder}/index")
    last = "ids array<bigint>" if with_ids else "ids_crc32 bigint"
    return _spread(index, index.count()).mapInArrow(
        partial(_read, folder=folder, with_ids=with_ids), f"doc_id bigint, start bigint, n_tokens bigint, {last}"
    )
