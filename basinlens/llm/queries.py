"""The registered queries of the text operators and, where SQL can express one, its check."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.llm import (
    alignment,
    byte_bpe,
    fingerprints,
    html_text,
    lexical_search,
    license_scan,
    mixing,
    neighbours,
    ngram_join,
    quality,
    token_counts,
    token_files,
    url_filter,
)
from basinlens.llm.common import scratch, table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    PLANS[f.__name__] = f
    return f


@query
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(table(spark, folder, "pages"))


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the token ids of all documents, and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements in all documents, line by line."""
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from binary files."""
    to = scratch(spark, "token-files")
    file = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, folder, "documents"), to, file, end_id=0, added_tokens=True)
    return token_files.read_token_files(spark, to, with_ids=False)


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in the order of a mixture whose sources weigh their document counts to the power 0.75: places and digests of the texts."""
    mixed = mixing.mix(table(spark, folder, "documents"), ordered=True)
    return mixed.select("doc_id", "source", "pass_no", "block", "slot", "position", F.sha2("text", 256).alias("text_sha256"))


@query
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5-word shingles, Jaccard of at least 0.8."""
    return ngram_join.similar_groups(table(spark, folder, "documents"))


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules, blocked_words=url_filter.BLOCKED_WORDS).drop("url")


CHECKS["op7_url_filter"] = rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select page_id, rh || rp rule, v, row_number() over (partition by page_id order by length(rh || rp) desc) k
    from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select p.page_id, host, path, rule, coalesce(v, case when list_has_any(string_split_regex(host, '[.-]'), {url_filter.BLOCKED_WORDS})
    then 'block' else 'allow' end) verdict from p left join f on p.page_id = f.page_id and k = 1
"""


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_with_edits(table(spark, folder, "documents"))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, site priors and verdict of all documents; host is the source, path the language within it."""
    judged = quality.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.drop("row_hash")


@query
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tokens of two tokenizers in all documents, and how their links compare with the whole corpus."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, folder, "documents"), *files)


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CHECKS["op12_lexical_search"] = r"""
with w as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
d as (select doc_id, r, len(ts) n, ts from w where len(ts) > 0),
c as (select count(*) docs, sum(n)::bigint l from d),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
p as (select r, t, count(*) tf from (select r, unnest(ts) t from d) where t in (select t from i) group by r, t),
q as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint w from p, c group by t, docs),
s as (select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::bigint score
    from i join p using (t) join q using (t) join d using (r), c group by item_id, doc_id, r),
k as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int rank, doc_id, score from s where score > 0)
select * from k where rank <= 10
"""


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of all documents, and how much of each lies within 1024 tokens."""
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
