"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs set bits in blocks of eight 64-bit words, one bit of each word, all in the block that the URL's hash
names; a look-up touches one block. The filter's size is bounded by ``MAX_BLOCKS`` whatever the list's length (a
longer list only lets more false hits through), so it may be broadcast. Only URLs that pass it are shuffled, to a hash
join with the list itself, which removes false hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import lower_ascii

#: Verdict, rule: the host (subdomains included) up to the first slash, then what the path starts with.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
WORDS, WORD_BITS, BITS_PER_URL = 8, 64, 16
#: Blocks of the filter at most: 128 Ki blocks of 64 bytes, 8 MB of bits.
MAX_BLOCKS = 1 << 17
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = "^(utm_[a-z]+|ref)="


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, number sign or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical_url(url: Column) -> Column:
    """Host without user and default port, path without slashes at its end, other than tracking parameters in order.

    The scheme and the fragment don't count. Null if there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":(80|443)?$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.substring(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3), 2, 1 << 30)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict); of equal length the last in order; null if none.

    Rules are a short list that becomes part of the plan.
    """
    cases = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        cases.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*cases)) if cases else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """The bit that a URL sets in a word of its block."""
    return F.shiftrightunsigned(F.xxhash64(url, F.lit(word)), 58).cast("int")


def _mask(url: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _bit(url, word))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks (block, w0, ..., w7) of a filter of the column ``canonical``; empty blocks have no row."""
    words = [F.bit_or(_mask(F.col("canonical"), i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, on_list: str = "block", off_list: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical) of each row of ``pages`` (page_id, url).

    The longest rule that fits decides; where none does, ``on_list`` if the canonical URL is one of ``listed``
    (canonical; nulls and repeats do no harm), else ``off_list``. A null URL or one without ``://`` has an empty host
    and path, no canonical URL, and gets ``off_list``. Repeated rows stay; other columns are ignored.
    """
    listed = listed.where("canonical is not null").select("canonical").distinct()
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("fit", fit).select("page_id", "host", "path", "canonical", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    blocks = min(MAX_BLOCKS, max(1, listed.count() * BITS_PER_URL // (WORDS * WORD_BITS)))
    passed = F.col("w0").isNotNull()
    for i in range(WORDS):
        passed = passed & (F.col(f"w{i}").bitwiseAND(_mask(F.col("canonical"), i)) != 0)
    open_url = F.when(F.col("rule").isNull() & F.col("canonical").isNotNull(), _block(F.col("canonical"), blocks))
    tested = ruled.withColumn("block", open_url).join(F.broadcast(bloom_blocks(listed, blocks)), "block", "left")
    tested = tested.withColumn("maybe", F.col("block").isNotNull() & F.coalesce(passed, F.lit(False)))
    hits = tested.where("maybe").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path", "rule", "ruled", "canonical"]
    both = tested.where("not maybe").select(*columns, F.lit(None).cast("boolean").alias("found")).unionByName(hits.select(*columns, "found"))
    method = F.when(F.col("found"), on_list).otherwise(off_list)
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "canonical")


def tracked_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages that were reached with a campaign parameter (``utm_``)."""
    return pages.where(F.col("url").rlike(r"[?&]utm_")).select(canonical_url(F.col("url")).alias("canonical"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, tracked_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(
    f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES
)
OP2_SQL = f"""
with parts as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '{_PARTS}', 2) as path,
    substring(regexp_extract(coalesce(url, ''), '{_PARTS}', 3), 2) as query
  from pages),
kept as (
  select *, array_to_string(list_sort(list_filter(string_split(query, '&'),
    lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))), '&') as params from parts),
named as (
  select page_id, url, host, path,
    case when host <> '' then regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', '')
      || regexp_replace(path, '/+$', '') || case when params <> '' then '?' || params else '' end end as canonical
  from kept),
listed as (select distinct canonical from named where regexp_matches(url, '[?&]utm_') and canonical is not null),
rules(verdict, rule, domain, start) as (values {_RULE_ROWS}),
fits as (
  select named.*, (select struct_pack(rule := r.rule, verdict := r.verdict) from rules r
    where (named.host = r.domain or ends_with(named.host, '.' || r.domain)) and starts_with(named.path, r.start)
    order by length(r.rule) desc, r.rule desc limit 1) as fit
  from named)
select page_id, host, path, fit.rule as rule,
  coalesce(fit.verdict, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict
from fits
"""
