"""Token counts, ranked search and cross-tokenizer alignment against brute force and the public libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from basinlens.llm import alignment, lexical_search, queries, token_counts
from basinlens.llm.common import table

FOLDER = "/root/testdata/sf0.001"
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = ", n int, terms string, tag int, key int, radix int, run string, block int, part int, value string"
PARTS = ["'re", "'ll", "'s", " ", "  ", "\n", "\t", "   ", "word", " hello", "!!", "<|endoftext|>", "é", "中文", "🙂", "123", " 9"]
PARTS += ["　", "\xa0", "<|", "endof", "'", "n't", "ſ", "'S", "Ω", "...", " .", "</s>", "<0x41>", "<unk>"]


def rows(spark, pairs, key="doc_id"):
    """Rows with extra columns that clash with what the operators name theirs."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "y", 5, 6, "z") for i, t in pairs], f"{key} bigint, text string{CLASH}")


def made_texts(seed, n=400):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(n)]


# token counts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_LEVEL)


@pytest.fixture(scope="module")
def counter():
    definition = token_counts.Definition(BYTE_LEVEL)
    return token_counts.Counter(definition.merges, definition.added)


def test_every_prefix_has_the_librarys_count(library, counter):
    for text in made_texts(1):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        counts = counter.counts(text)
        assert [counts.count(k) for k in range(len(text) + 1)] == want, text
        assert counts.table().tolist() == want[1:]
        for budget in range(-1, want[-1] + 2):
            assert counts.longest(budget) == max((k for k, n in enumerate(want) if n <= budget), default=0), (text, budget)


def test_listed_merges_alone_join():
    """A vocabulary of listed pairs answers what the codec's vocabulary asks of it: "bcd" is a token, "bc" + "d" is not listed."""
    listed = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "cd"), ("ab", "cd"), ("a", "a"), ("aa", "b"), ("d", "aa")]
    symbols = ["a", "b", "c", "d"]
    vocab = {t: i for i, t in enumerate([*symbols, *dict.fromkeys(a + b for a, b in listed)])}
    bpe = tokenizers.Tokenizer(tokenizers.models.BPE(vocab, listed))
    merges = token_counts.Merges([(a.encode(), b.encode()) for a, b in listed])
    counter, pick = token_counts.Counter(merges), random.Random(3)
    for text in ("".join(pick.choices(symbols, k=pick.randint(1, 24))) for _ in range(500)):
        assert counter.counts(text).total == len(bpe.encode(text).ids), text


def test_questions_encode_nothing_again(counter, monkeypatch):
    counts = counter.counts("Alignment of a watershed's boundaries, told in words. " * 50)
    for piece in counter.splitter.split(counts.text):
        counter.prefixes_of(piece)
    monkeypatch.setattr(type(counter.merges), "fit", lambda *_: pytest.fail("encoded again"))
    assert [counts.longest(b) for b in range(0, counts.total, 7)] == sorted(counts.longest(b) for b in range(0, counts.total, 7))


def test_long_runs_without_a_break(library, counter):
    for text in ("a" * 50_000, "ab1" * 9_000, "é" * 20_000, " " * 30_000, "!?" * 20_000):
        assert counter.counts(text).total == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_the_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 1024)
        assert len(library.encode(text[: got[i].chars_within], add_special_tokens=False).ids) <= 1024


def test_token_counts_of_odd_rows(spark, library):
    texts = [None, "", " ", "a<|endoftext|>b", "x y" * 40_000, "same", "same"]
    docs = rows(spark, [*enumerate(texts), (None, "no id"), (5, "same")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE_LEVEL).collect())
    want = [(False, i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert got == sorted([*want, (False, 5, 1), (True, 0, 2)])
    assert token_counts.count_tokens(docs.limit(0), BYTE_LEVEL).count() == 0


def test_stored_prefixes_answer_with_columns(spark, library):
    texts = [*made_texts(3, 40), "", None]
    stored = token_counts.prefix_tokens(rows(spark, enumerate(texts)), BYTE_LEVEL)
    for row in stored.select("doc_id", "prefix_tokens", token_counts.within("prefix_tokens", 5).alias("fit")).collect():
        text = texts[row.doc_id] or ""
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert row.prefix_tokens == want[1:] and row.fit == max(k for k, n in enumerate(want) if n <= 5)


# ranked search


def ranked(docs, items, top=10):
    """[(item_id, rank, doc_id, score)] of (id, text) rows, term by term."""
    fold = {c: c + 32 for c in range(65, 91)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    holding = Counter(t for _, c, _ in counted for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) for t in terms}
        scored = []
        for doc, c, n in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_shared_sets_make_up_their_items():
    pick = random.Random(5)
    for size in (0, 1, 2, 9, 40):
        common = [set(pick.sample(range(60), 12)) for _ in range(4)]
        members = [set().union(*pick.sample(common, pick.randint(0, 3)), pick.sample(range(80), pick.randint(0, 6))) for _ in range(size)]
        children, levels = lexical_search.share(members)
        leaves = 1 + max((max(m) for m in members if m), default=-1)
        assert levels == sorted(levels)
        made: list[list[int]] = []
        for node in children:
            made.append([x for c in node for x in ([c] if c < leaves else made[c - leaves])])
        for member, node in zip(members, made[len(made) - size :], strict=True):
            assert sorted(node) == sorted(member)  # each term once
        uses = Counter(c for node in children for c in node if c >= leaves)
        assert all(uses[leaves + i] >= 1 for i in range(len(children) - size))
        if size >= 9:
            assert sum(map(len, children)) < sum(map(len, members))


def test_search_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    assert found(queries.op12_lexical_search(spark, FOLDER)) == ranked(docs, items)


def test_search_of_odd_rows_in_blocks_and_portions(spark, monkeypatch):
    pick = random.Random(9)
    words = ["The", "water", "wATER", "ÄRA", "ära", "x1", "0", "naïve", "\x7fA", "b\x00c", "zz", "q"]
    texts = [" ".join(pick.choices(words, k=pick.randint(0, 30))) for _ in range(60)]
    docs = [*enumerate(texts), (7, "water water"), (None, "water ära"), (None, "water ära"), (61, None), (62, ""), (63, "!?"), (64, "water " * 100_000)]
    items = [*enumerate([" ".join(pick.choices(words, k=pick.randint(0, 5))) for _ in range(25)]), (3, "zz"), (3, "zz"), (None, "water"), (30, None), (31, "nowhere")]
    monkeypatch.setattr(lexical_search, "DOCUMENTS", 7)
    monkeypatch.setattr(lexical_search, "PORTION_BYTES", 600)
    args = rows(spark, docs), rows(spark, items, "item_id")
    assert found(lexical_search.search(*args, block_items=4)) == ranked(docs, items)
    assert found(lexical_search.search(args[0].limit(0), args[1])) == [] == found(lexical_search.search(args[0], args[1].limit(0)))


# alignment


def brute_alignment(docs):
    """{row: values} by the libraries on whole texts and all overlapping token pairs."""
    first = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbols = token_counts.byte_symbols()

    def spans(parts):
        at = 0
        for p in parts:
            yield at, at + len(p)
            at += len(p)

    linked, counts = [], Counter()
    for _, text in docs:
        source = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [bytes(symbols[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != source or b"".join(b_bytes) != source:
            linked.append(None)
            continue
        sa, sb = list(spans(a_bytes)), list(spans(b_bytes))
        links = [(y, x) for x, (s, e) in zip(a, sa, strict=True) for y, (t, f) in zip(b, sb, strict=True) if s < f and t < e]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for high in ends:
            inside = lambda ids, spans: ",".join(str(i) for i, (s, _) in zip(ids, spans, strict=True) if low <= s < high)  # noqa: B023, E731
            groups.append(f"{inside(a, sa)}|{inside(b, sb)}")
            low = high
        linked.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    highest: dict = {}
    for (b, _), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for (key, _), row in zip(docs, linked, strict=True):
        if row is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = row
            best = sum(counts[pair] == highest[pair[0]] for pair in links)
            out.append((key, n_a, n_b, n_groups, len(links), best, sum(counts[pair] for pair in links), digest))
    return sorted(out, key=str)


def aligned(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_alignment_of_the_table(spark):
    short = table(spark, FOLDER, "documents").where("length(text) < 2500")
    docs = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    assert len(docs) > 100
    assert aligned(alignment.align(short, BYTE_LEVEL, PIECES)) == brute_alignment(docs)
    assert queries.op11_alignment(spark, FOLDER).count() == table(spark, FOLDER, "documents").count()


def test_alignment_of_odd_rows_in_many_runs(spark, monkeypatch):
    texts = [*made_texts(11, 150), None, "", "▁x", "a\x00b", "same text", "same text", "x y \x85z　w", " ", "  lead", "trail  "]
    docs = [*enumerate(texts), (None, "no id"), (4, "twice")]
    for name, value in {"RUN_DOCUMENTS": 3, "FAN": 4, "SPREAD": 5, "CACHED_CHUNKS": 40}.items():
        monkeypatch.setattr(alignment, name, value)
    frame = rows(spark, docs)
    assert aligned(alignment.align(frame, BYTE_LEVEL, PIECES)) == brute_alignment(docs)
    assert alignment.align(frame.limit(0), BYTE_LEVEL, PIECES).count() == 0


def test_a_long_text_is_aligned_whole(spark):
    text = "Boundaries of watersheds, told in naïve words; " * 4000
    (row,) = alignment.align(rows(spark, [(1, text)]), BYTE_LEVEL, PIECES).collect()
    first = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    assert (row.n_a, row.n_b) == (len(first.encode(" " + text).ids), len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)))
    assert row.n_best <= row.n_links <= row.count_sum
