"""URL filters by Bloom filter cascades.

Rules name a host and the beginning of a path; a list of words names what hosts of unwanted
sites are called.  The keys they can name are, for every URL of the corpus, the suffixes of
its host with the beginnings of its path, and the words of its host.  The first level of a cascade is a Bloom filter of the
listed keys; the second holds those other keys of the corpus that the first wrongly lets
pass, the third those listed keys that the second wrongly lets pass, and so on until no
error is left.  Over the keys it was built for a cascade is exact, so pages are judged
without a join; it takes a few bits per listed key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import sized, written

MAX_BITS = 1 << 27  # of one level: 16 MB on the driver and in each task
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: Iterable[int]) -> Column:
    """Every host suffix at a dot with the beginnings of these lengths of the path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def host_words(host: Column) -> Column:
    """The words between the dots and hyphens of a host, marked so that no rule is equal to one."""
    return F.transform(F.filter(F.split(host, "[.-]"), lambda w: w != ""), lambda w: F.concat(F.lit("#"), w))


@dataclass
class Level:
    words: np.ndarray
    bits: int
    hashes: int
    salt: int

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for j in range(self.hashes):
            at = _positions(h1, h2, self.bits, j, self.salt)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int, j: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        return (x + np.uint64(j) * (h2.astype(np.uint64) | np.uint64(1))) % np.uint64(bits)


@dataclass
class Cascade:
    """Levels in turn of listed keys and of other keys that pass so far."""

    levels: list[Level]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        listed = np.zeros(len(h1), dtype=bool)
        open_rows = np.arange(len(h1))
        for number, level in enumerate(self.levels):
            passed = level.passes(h1[open_rows], h2[open_rows])
            # stopped by a level of listed keys: not listed; by a level of others: listed
            listed[open_rows[~passed]] = number % 2 == 1
            open_rows = open_rows[passed]
        listed[open_rows] = len(self.levels) % 2 == 1
        return listed


def _bits_of(keys: DataFrame, bits: int, hashes: int, salt: int) -> np.ndarray:
    """The filter's words: each task ORs its keys' bits, then each word is ORed once."""

    @F.pandas_udf("array<bigint>")
    def positions(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
        at = np.stack([_positions(a, b, bits, j, salt) for j in range(hashes)], axis=1).astype(np.int64)
        return pd.Series(list(at))

    at = keys.select(F.explode(positions("h1", "h2")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")
    )
    rows = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(-(-bits // 64), dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def _passes(level):
    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(level.value.passes(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return passes


def build_cascade(universe: DataFrame) -> Cascade | None:
    """A cascade exact for all keys of ``universe`` (h1, h2, listed); None if a level would pass MAX_BITS."""
    levels: list[Level] = []
    inside, outside = universe.where("listed").select("h1", "h2"), universe.where("not listed").select("h1", "h2")
    count, others = inside.count(), outside.count()
    while count:
        # the first level lets pass about as many others as there are listed keys; later ones half
        rate = min(0.5, max(1e-6, count / max(1, others))) if not levels else 0.5
        bits = max(64, 64 * math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
        if bits > MAX_BITS:
            return None
        hashes = max(1, round(math.log2(1 / rate)))
        level = Level(_bits_of(inside, bits, hashes, len(levels)), bits, hashes, len(levels))
        levels.append(level)
        shared = universe.sparkSession.sparkContext.broadcast(level)
        wrong = written(outside.where(_passes(shared)("h1", "h2")), "passing")
        inside, outside, count = wrong, inside, wrong.count()
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", blocked_words: Iterable[str] = ()) -> DataFrame:
    """``pages``, all columns, with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` holds (rule, verdict): a rule is a host and the beginning of a path, such as
    ``example.net/en/``, the verdict ``allow`` or ``block``.  A rule fits its host and all
    subdomains where the path begins as it says; the longest rule that fits decides.
    Without one ``rule`` is null, and the URL is blocked if a word of its host (between dots
    and hyphens) is one of ``blocked_words``.  A rule listed twice, or with both verdicts, blocks.

    A null or empty URL, or one without ``://``, has an empty host and path.  Repeated rows
    and an empty table come through as they are; columns named like the new ones are
    replaced.  Rules that name no key of the corpus take no space.  A page is looked up once
    per host suffix and length of the rules' paths, however many lengths there are.  Should a level outgrow
    MAX_BITS, that list is joined instead.
    """
    added = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col(url).cast("string"))
    kept = [c for c in pages.columns if c not in added]
    parted = pages.select(*kept, host.alias("_host"), path.alias("_path"))
    rules = written(
        rules.where("rule is not null and verdict in ('allow', 'block')").groupBy("rule").agg(F.max("verdict").alias("verdict")), "rules"
    )
    # different lengths of paths: no more than the longest path has characters
    lengths = sorted(r[0] for r in rules.select(F.length("rule") - F.locate("/", "rule") + 1).distinct().collect())
    keys = candidate_keys(F.col("_host"), F.col("_path"), lengths) if lengths else F.array().cast("array<string>")
    keys = F.concat(keys, host_words(F.col("_host")))
    words = [(f"#{w.lower()}", "block") for w in sorted(set(blocked_words))]
    if words:
        rules = rules.unionByName(pages.sparkSession.createDataFrame(words, "rule string, verdict string"))

    hashes = [F.xxhash64("rule").alias("h1"), F.xxhash64(F.lit(1), F.col("rule")).alias("h2")]
    universe = parted.select("_host", *[F.substring("_path", 1, max(lengths, default=0)).alias("_path")]).distinct()
    universe = universe.select(F.explode(keys).alias("rule")).distinct()
    universe = written(universe.join(sized(rules), "rule", "left").select("rule", "verdict", *hashes), "keys")
    cascades = {
        v: build_cascade(universe.select("h1", "h2", F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed"))) for v in ("allow", "block")
    }
    if None in cascades.values():
        return _joined(parted, rules, keys, kept)
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Per key 0 (in no list), 1 (allowed) or 2 (blocked)."""
        sizes = [len(x) for x in h1]
        if not sum(sizes):
            return pd.Series([np.zeros(0, np.int32) for _ in sizes])
        a, b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in h]) for h in (h1, h2))
        found = shared.value["allow"].contains(a, b).astype(np.int32) + 2 * shared.value["block"].contains(a, b).astype(np.int32)
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

    keyed = parted.withColumn("_keys", keys)
    found = keyed.withColumn(
        "_found",
        listed(F.transform("_keys", lambda k: F.xxhash64(k)), F.transform("_keys", lambda k: F.xxhash64(F.lit(1), k))),
    )
    fitting = F.filter(
        F.arrays_zip(F.transform("_keys", lambda k: F.length(k)).alias("n"), F.col("_keys").alias("k"), F.col("_found").alias("v")),
        lambda x: x["v"] > 0,
    )
    fitting = F.transform(fitting, lambda x: F.struct((~x["k"].startswith("#")).alias("is_rule"), x["n"], x["k"], x["v"]))
    return _finish(found.withColumn("_best", F.array_max(fitting)), kept)


def _finish(best: DataFrame, kept: list[str]) -> DataFrame:
    verdict = F.when(F.col("_best.v") == 2, "block").otherwise("allow")
    return best.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(F.col("_best.is_rule"), F.col("_best.k")).alias("rule"), verdict.alias("verdict"))


def _joined(parted: DataFrame, rules: DataFrame, keys: Column, kept: list[str]) -> DataFrame:
    """For lists beyond MAX_BITS: the keys of each distinct place are joined with the rules."""
    places = written(parted.select("_host", "_path").distinct(), "places")
    fits = places.select("_host", "_path", F.explode(keys).alias("k")).join(rules.withColumnRenamed("rule", "k"), "k")
    fits = fits.withColumn("_one", F.struct((~F.col("k").startswith("#")).alias("is_rule"), F.length("k").alias("n"), "k", F.when(F.col("verdict") == "block", 2).otherwise(1).alias("v")))
    best = fits.groupBy("_host", "_path").agg(F.max("_one").alias("_best"))
    return _finish(parted.join(best, ["_host", "_path"], "left"), kept)


#: The rules of the registered query, fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words of unwanted hosts, a parameter of the registered query.
BLOCKED_WORDS = "ad ads adserver adult advert bet bets betting casino gambling lottery malware pills poker porn sex slots spam viagra warez xxx".split()
