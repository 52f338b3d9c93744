"""N-gram join, byte-level BPE and token files against brute force and the public libraries."""

import base64
import hashlib
import os
import random
import subprocess
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from basinlens.llm import byte_bpe, common, ngram_join, queries, token_files
from basinlens.llm.common import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, n_shingles int, slot int, part string, label int"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(30_000))


def rows(spark, pairs):
    """Documents with extra columns that clash with what the operators name theirs."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in pairs], SCHEMA)


def brute_force(docs):
    sets = {i: ngram_join.ngram_set((t or "").encode(), 5) for i, t in docs.items()}
    label = {i: i for i in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(docs)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            union = len(sets[a]) + len(sets[b]) - shared
            if union and 100 * shared >= 80 * union:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_sets():
    one = ngram_join.ngram_set(b"A b\x0bC  d\te", 5)
    assert len(one) == 1 and one == ngram_join.ngram_set("a B c d E".encode(), 5)
    assert len(ngram_join.ngram_set("É b c d e f".encode(), 5)) == 2
    assert ngram_join.ngram_set("É".encode(), 5) != ngram_join.ngram_set("é".encode(), 5)
    assert len(ngram_join.ngram_set(b" \n", 5)) == 0 and len(ngram_join.ngram_set(None, 5)) == 0
    assert len(ngram_join.ngram_set(b"a b", 5)) == 1


def test_join_equals_brute_force_on_a_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, FOLDER).collect()}
    assert got == brute_force(docs)


def test_join_with_hot_groups_and_edges(spark, monkeypatch):
    """Chains at the threshold, a hot group of near copies, a passage everybody has; tiny cells so that all cuts happen."""
    monkeypatch.setattr(ngram_join, "TOKENS_PER_CELL", 400)
    monkeypatch.setattr(ngram_join, "TOKENS_PER_CLUSTER", 300)
    monkeypatch.setattr(ngram_join, "COMMON_SHARE", 4)
    r = random.Random(5)
    docs = {}
    base = [f"t{i}" for i in range(60)]
    for i in range(90):  # near copies, some linked through others alone
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"e{r.randrange(30)}"
        docs[1000 - i] = " ".join(words)
    passage = [f"p{i}" for i in range(40)]
    for i in range(90):  # a common passage and words of one's own
        docs[2000 + i] = " ".join(passage + [f"own{i}-{j}" for j in range(r.choice([2, 6, 12, 60]))])
    for i in range(40):
        docs[3000 + i] = " ".join(f"c{j}" for j in range(i, i + 30))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_groups(rows(spark, docs.items())).collect()}
    assert got == brute_force(docs)


def test_join_with_nulls_copies_and_long_texts(spark):
    pairs = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b C d e  f"), (None, "a b c d e f"), (7, None), (8, ""), (9, "one two"), (2, "ONE two"),
             (10, LONG), (11, LONG + " end"), (12, "q r s t u v"), (12, "x y z u v w"), (1, "x y z u v w")]
    got = sorted(map(tuple, ngram_join.similar_groups(rows(spark, pairs)).collect()), key=str)
    n = len(ngram_join.ngram_set(LONG.encode(), 5))
    want = [(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (7, 0, 7), (8, 0, 8), (9, 1, 2), (2, 1, 2), (10, n, 10), (11, n + 1, 10),
            (12, 2, 1), (12, 2, 1), (1, 2, 1)]
    assert got == sorted(want, key=str)
    assert ngram_join.similar_groups(rows(spark, [])).collect() == []


def test_ngrams_travel_without_their_sets_keys():
    """In 3,000 ranges nearly every n-gram is alone with its set: 16 bytes of key and counts beside 4 of its own made the shuffle grow faster than the input."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)).encode() for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(400), "text": pa.array(texts, pa.binary())})
    common, copies = SimpleNamespace(value=np.empty(0, np.uint64)), SimpleNamespace(value=(np.empty(0, np.int64), np.empty(0, np.int64)))
    dealt = list(ngram_join._deal(iter([batch]), 5, 3000, common, copies, 4, 5))
    sent = sum(len(v) for b in dealt for c in ("keys", "slacks", "owners", "tokens") for v in b.column(c).to_pylist() if v)
    ngrams = sum(len(ngram_join.ngram_set(t, 5)) for t in texts)
    assert sum(len(v) // 2 for b in dealt for v in b.column("owners").drop_null().to_pylist()) == ngrams
    assert sent < 7 * ngrams


def test_join_without_knowing_the_copies(spark, monkeypatch):
    """Beyond a bound tasks do not know which sets have copies elsewhere; the result is the same."""
    monkeypatch.setattr(ngram_join, "COPIED_SETS", 1)
    monkeypatch.setattr(ngram_join, "FLUSH_SETS", 3)
    r = random.Random(9)
    base = [[f"t{k}-{i}" for i in range(40)] for k in range(4)]
    docs = {}
    for i in range(60):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(40)] = f"e{r.randrange(9)}"
        docs[i] = " ".join(words if i % 2 else r.choice(base))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_groups(rows(spark, docs.items())).collect()}
    assert got == brute_force(docs)


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN)


def random_texts(count):
    r = random.Random(11)
    alphabet = ["a", "b", "the ", " ing", "'s", "é", "ß", "_", "12", "²", "\n", "  ", " ", "\x1c", "漢", "😀", "é", "!!", "tion", "१"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(count)]


def test_encoding_equals_the_library(known, codec):
    for text in [*random_texts(1500), "a" * 5000, " " * 300 + "x", "\n" * 99, LONG[:20_000], "<|endoftext|>"]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_prefixes_appends_and_edits(known, codec):
    r = random.Random(3)
    core = known._core_bpe
    for _ in range(60):
        data = bytes(r.choice(b"thersanion ") for _ in range(r.randint(80, 160)))
        entry = byte_bpe.PrefixEncoding(codec.vocabulary, data[:10])
        entry.append(data[10:])
        for end in (1, 7, 40, len(data)):
            assert entry.ids(end) == core.encode_single_piece(data[:end])
        a = r.randrange(20)
        new = bytes(r.choice(b"abc") for _ in range(r.randint(0, 5)))
        entry.replace(a, a + 4, new)
        assert entry.data == data[:a] + new + data[a + 4 :]
        assert entry.ids() == core.encode_single_piece(entry.data)
    entry = byte_bpe.PrefixEncoding(codec.vocabulary, b"the one that is here for thing " * 200)
    assert entry.replace(50, 51, b"q") < 500  # far fewer entries than there are bytes


def test_full_caches_leave_room_for_other_workers():
    """Varied words fill all caches of a worker; it grows by less than 140 MB over its libraries."""
    code = f"""
import random, re
from basinlens.llm import byte_bpe
used = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before, r = used(), random.Random(5)
codec = byte_bpe.Codec(byte_bpe.read_ranks({RANK_FILE!r}))
for _ in range(500):
    codec.encode(" ".join("".join(r.choices("etaoinshrdlucmfw", k=r.randint(5, 9))) for _ in range(1000)))
print(used() - before)
"""
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 140


def test_edited_texts(known, codec):
    r = random.Random(8)
    for text in random_texts(150):
        doc = byte_bpe.EncodedText(codec, text)
        doc.append("  'll x")
        text += "  'll x"
        assert (doc.text, doc.ids) == (text, known.encode_ordinary(text))
        a = r.randrange(len(text))
        b = min(len(text), a + r.randint(0, 6))
        new = r.choice(["", " ", "s", "'", "é1 "])
        doc.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert (doc.text, doc.ids) == (text, known.encode_ordinary(text))


def test_digests_on_a_table_and_on_edges(spark, known):
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digest(text):
        ids = np.array(known.encode_ordinary(text or ""), "<u4")
        return len(ids), sha(ids.tobytes()), sha((text or "").encode())

    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_byte_bpe(spark, FOLDER).collect()}
    assert got == {i: digest(t) for i, t in docs.items()}
    pairs = [(1, None), (1, ""), (None, "a\u0000b"), (2, LONG), (2, LONG)]
    got = byte_bpe.token_digests(rows(spark, pairs), RANK_FILE).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *digest(t)) for i, t in pairs], key=str)
    assert byte_bpe.token_digests(rows(spark, []), RANK_FILE).collect() == []
    ids = byte_bpe.with_token_ids(rows(spark, pairs[:3]), RANK_FILE, column="label").select("text", "label").collect()
    assert all(r.label == known.encode_ordinary(r.text or "") for r in ids)


def test_token_files(spark, folder):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    library.encode_special_tokens = True

    def encoded(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")

    docs = sorted((r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_files(spark, FOLDER).collect()}
    at, want = 0, {}
    for i, text in docs:
        ids = encoded(text)
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want

    pairs = [(4, "b"), (None, "z"), (2, None), (9, LONG), (4, "b"), (3, "<|endoftext|> ²x")]
    token_files.write_token_files(rows(spark, pairs), f"{folder}/t", file, end_id=0)
    got = sorted(token_files.read_token_files(spark, f"{folder}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 3, 4, 4, 9]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.ids for r in got] == [encoded(t).tolist() for t in ["z", None, "<|endoftext|> ²x", "b", "b", LONG]]
    token_files.write_token_files(rows(spark, []), f"{folder}/e", file, end_id=0)
    assert token_files.read_token_files(spark, f"{folder}/e").collect() == []


def test_unseen_pieces_go_to_the_model_alone(monkeypatch):
    """Pieces need no call of the whole library, which costs more CPU than their merges; generations of them move on."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        definition = f.read()
    library = tokenizers.Tokenizer.from_str(definition)
    texts = ["it's  new\n\n naïve 中文 🙂 x123", "", "qwzx " * 20 + "y" * 200, "it's Qwzxvy 'll_ \x1c\t!"] * 3
    texts += [f"word{i * i} of wörd{i}" for i in range(200)]
    monkeypatch.setattr(token_files, "CACHED_PIECES", 20)
    pieces = token_files.PieceTokenizer(definition, added_tokens=True)
    pieces.tokenizer = None
    got = [np.frombuffer(ids, pieces.kind).tolist() for ids in pieces.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(pieces.recent) + len(pieces.recent.older) < 100


def test_token_files_as_the_unmodified_library(spark, folder):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    texts = ["a<|endoftext|>b", "plain", " x <|endoftext|>  ", "<|endoftext|", None]
    token_files.write_token_files(rows(spark, list(enumerate(texts))), f"{folder}/added", file, end_id=0, added_tokens=True)
    got = {r.doc_id: r.ids for r in token_files.read_token_files(spark, f"{folder}/added").collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_star_rounds_join_links_like_one_task(spark, monkeypatch):
    """Beyond FEW_LINKS links are joined in rounds; forced here on the table and on chains, stars and copies."""
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, FOLDER).collect()}
    assert got == brute_force(docs)
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(pick.randrange(300, 420), pick.randrange(300, 420)) for _ in range(90)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links + [(b, a) for a, b in links[:20]], "a long, b long")
    out = {r.node: r.label for r in common.connected_components(frame, "test").collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x: root(x) for x in touched}
