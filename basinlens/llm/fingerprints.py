"""Document fingerprints by consistent weighted sampling.

A document is a bag of lower-cased words, weighted by how often they occur.  Sample k of a
word of weight w draws, from a hash of word and k alone, r and c from Gamma(2, 1) and b
from the unit interval; with t = floor(ln w / r + b) its key is ln c - r * (t - b + 1).
The smallest key over the words is the document's sample k.  A key depends on word, k and
t, so two documents have the same sample with a chance equal to the generalised Jaccard
similarity of their weights, sum of minima over sum of maxima.  A fingerprint holds
``SAMPLES`` samples, as 31-bit hashes; likeness is the share of equal ones.

Column expressions only: words are grouped within the partition their document was
dealt to, so nothing but documents is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import written
from basinlens.operators.common import global_row_number

SAMPLES = 64
SPACE = "[\\x20\\x09-\\x0D]+"


def sample_key(word: str, log_weight: str, k: int) -> Column:
    """The key of sample ``k`` for a word hash and the logarithm of its weight (columns by name)."""
    g, h = f"xxhash64({word}, {k})", f"xxhash64({k}, {word})"

    def uniform(source: str, at: int) -> str:
        """65536 times a uniform variate of the open unit interval, from 16 bits."""
        return f"((shiftrightunsigned({source}, {at}) & 65535) + 0.5D)"

    bits = f"{2 * math.log(65536)!r}D"
    r = f"({bits} - ln({uniform(g, 0)} * {uniform(g, 16)}))"  # -ln(u * v) is Gamma(2, 1)
    b = f"({uniform(g, 32)} / 65536D)"
    c = f"({bits} - ln({uniform(h, 0)} * {uniform(h, 16)}))"
    # a word that occurs once has t = 0
    step = f"CASE WHEN {log_weight} = 0D THEN {r} * (1D - {b}) ELSE {r} * (floor({log_weight} / {r} + {b}) - {b} + 1D) END"
    return F.expr(f"ln({c}) - {step}")


def least_keys(weights: DataFrame, keys: Sequence[str], samples: int = SAMPLES) -> DataFrame:
    """(keys..., _0, _1, ...): the smallest keys over words ``_w`` with logarithms of weights ``_l``."""
    return weights.groupBy(*keys).agg(*[F.min(sample_key("_w", "_l", k)).alias(f"_{k}") for k in range(samples)])


def as_samples(names: Sequence[str]) -> Column:
    """Keys folded to 31 bits each; null where there were no words."""
    return F.array(*[F.when(F.col(n).isNotNull(), F.xxhash64(n).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")) for n in names])


def words_of(text: Column) -> Column:
    return F.explode(F.split(F.lower(text), SPACE))


def fingerprint(texts: DataFrame, keys: Sequence[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys..., samples array<int>) of every text with words; rows must be distinct in ``keys``.

    Where ``texts`` is dealt by some of ``keys`` already, there is no further shuffle.
    """
    words = texts.select(*keys, words_of(F.col(text)).alias("_w")).where("_w <> ''").select(*keys, F.xxhash64("_w").alias("_w"))
    weights = words.groupBy(*keys, "_w").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("_l"))
    return least_keys(weights, keys, samples).select(*keys, as_samples([f"_{k}" for k in range(samples)]).alias("samples"))


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits a sample; a hyphen for each of a text without words."""
    return F.concat_ws(
        "", F.transform(samples, lambda s: F.coalesce(F.lower(F.lpad(F.hex(s.cast("bigint")), 8, "0")), F.lit("-")))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one of them is like no text with words."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda total, x: total + x) / F.size(a)


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points (rounded down) replaced by the
    first as many of the next document in ascending order of key, null keys first and equal
    keys by a hash of the text; the last document's next is the first.  A null text counts
    as empty.  Rows equal in key and text are one document, returned as often as it came.
    An empty table gives an empty result; other columns are ignored.

    Texts are shuffled once, by a hash of key and text, and a quarter of them again.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), whole.alias("text")).select(
        "doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), "text").alias("k1"),
        F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), F.col("text")).alias("k2"),
    )
    narrow = base.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("copies")
    )
    numbered = global_row_number(narrow, [F.asc_nulls_first("doc_id"), F.asc("k1"), F.asc("k2")], "at", start=0)
    numbered = written(numbered, "numbered")
    rows = numbered.count()
    repeated = numbered.where("copies > 1").select("k1", "k2")

    after = numbered.select((F.col("at") - 1).alias("at"), F.col("k1").alias("next1"), F.col("k2").alias("next2"))
    after = after.withColumn("at", F.when(F.col("at") < 0, rows - 1).otherwise(F.col("at")))
    links = written(numbered.join(after, "at").withColumn("q", F.floor(F.col("n") / 4).cast("int")), "links")

    texts = base.select("k1", "k2", "text")
    if not repeated.isEmpty():
        once = texts.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
        texts = texts.join(repeated, ["k1", "k2"], "left_anti").unionByName(once)
    wanted = links.select(F.col("next1").alias("k1"), F.col("next2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), "q")
    pieces = texts.join(wanted.hint("merge"), ["k1", "k2"]).select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.expr("left(text, q)").alias("piece")
    )
    both = texts.join(links.select("k1", "k2", "n", "q").hint("merge"), ["k1", "k2"]).join(pieces.hint("merge"), ["k1", "k2"])
    head = F.expr("left(text, n - q)")
    hashed = both.select("k1", "k2", F.sha2(F.concat(head, "piece"), 256).alias("edited_sha256"))
    # both texts share the words before the last one of the kept part: those are counted once
    same = F.regexp_extract(head, f"(?s)^(.*{SPACE[:-1]})", 1)
    cut = both.withColumn("same", same).withColumn("rest", F.expr("substring(text, length(same) + 1, n - q - length(same))"))
    parts = cut.select("k1", "k2", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.col("same").alias("body")),
        F.struct(F.lit(1).alias("part"), F.expr("substring(text, length(same) + 1)").alias("body")),
        F.struct(F.lit(2).alias("part"), F.concat("rest", "piece").alias("body")),
    )).alias("v")).select("k1", "k2", "v.part", "v.body")
    words = parts.select("k1", "k2", "part", words_of(F.col("body")).alias("_w")).where("_w <> ''")
    counts = words.select("k1", "k2", F.xxhash64("_w").alias("_w"), "part").groupBy("k1", "k2", "_w").agg(
        F.count_if(F.col("part") < 2).alias("own"), F.count_if(F.col("part") != 1).alias("other")
    )
    # which texts a weight counts for: 1 the text, 2 the edited one, 3 both
    logs = [F.struct(F.lit(mask).alias("mask"), F.ln(F.col(c).cast("double")).alias("_l")) for mask, c in ((1, "own"), (2, "other"), (3, "own"))]
    uses = F.when(F.col("own") == F.col("other"), F.array(logs[2])).when(F.col("other") == 0, F.array(logs[0])).when(
        F.col("own") == 0, F.array(logs[1])
    ).otherwise(F.array(logs[0], logs[1]))
    weights = counts.select("k1", "k2", "_w", F.explode(uses).alias("v")).select("k1", "k2", "_w", "v.mask", "v._l")
    least = least_keys(weights, ["k1", "k2", "mask"], samples)
    names = [f"_{k}" for k in range(samples)]
    both_keys = least.groupBy("k1", "k2").agg(
        *[F.min(F.when(F.col("mask") != 2, F.col(n))).alias(f"a{n}") for n in names],
        *[F.min(F.when(F.col("mask") != 1, F.col(n))).alias(f"b{n}") for n in names],
    )
    signed = both_keys.select("k1", "k2", as_samples([f"a{n}" for n in names]).alias("own"), as_samples([f"b{n}" for n in names]).alias("other"))
    none = F.array_repeat(F.lit(None).cast("int"), samples)
    signed = hashed.join(signed, ["k1", "k2"], "left").select(
        "k1", "k2", "edited_sha256", F.coalesce("own", none).alias("own"), F.coalesce("other", none).alias("other")
    )
    signed = written(signed, "samples")
    placed = links.join(signed, ["k1", "k2"])
    following = signed.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("own").alias("next"))
    out = placed.join(following, ["next1", "next2"])
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select(
        F.col("doc_id").alias(key),
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
