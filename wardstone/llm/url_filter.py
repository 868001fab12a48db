"""URL filters: a blocked Bloom filter in front of an exact join.

The list holds canonical URLs (host, then path) and rules (a host with all its subdomains, and the start of a path).
Every key of the list sets bits in one block of a blocked Bloom filter: a row of eight 32-bit words chosen by the key's
hash. A URL looks up the keys that could fit it: its canonical URL, and the suffixes of its host with the starts of its path
whose numbers of labels and of characters some rule has. Keys that the filter lets pass go on to a hash join with the list itself, which removes the
false positives. The longest fitting rule decides; without one, a listed canonical URL is blocked, anything else allowed.

The filter has a block for every eight keys (256 bits); it is broadcast while it is under a checked size, else joined on
its block by a shuffle. The list is joined by shuffle or broadcast as its size has it. A hot key of many URLs is one row of the
list, and URLs that pass the filter are made distinct by key first, so no key gathers all its URLs.

A null URL, or one without "://", has an empty host and path and fits nothing; such rows take no part in the joins. A null page id is kept. Repeated rows keep
a row each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

WORDS = 8
BROADCAST_ROWS = 1 << 17  # of 72 bytes
KEYS = 8  # of a block
SEPARATOR = "\x01"  # between host and path in keys of rules: rules and canonical URLs never meet


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its bit in each of the block's words."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(h, F.lit(blocks))
    bit = F.lit([1 << b for b in range(32)]).cast("array<long>")
    return block, [F.get(bit, F.shiftrightunsigned(g, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): one row for each block that has a key; summed before the shuffle."""
    block, bits = _bits(F.col("key"), blocks)
    return keys.groupBy(block.alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits)])


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``candidates`` whose key may be in the list."""
    block, bits = _bits(F.col("key"), blocks)
    named = candidates.select("*", block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    side = F.broadcast(bloom) if blocks <= BROADCAST_ROWS else bloom
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    return named.join(side, "block").where(hit).select(*candidates.columns)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict). ``rules`` are (host, start of path, verdict); ``listed`` is (canonical)."""
    session = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = rows.where("host != ''").select("host", "path").distinct()
    table_of = session.range(1).select(F.explode(F.array(*[F.struct(F.lit(h + SEPARATOR + p).alias("key"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in rules])).alias("r")).select("r.*") if rules else session.range(0).select(F.lit("").alias("key"), F.lit("").alias("rule"), F.lit("").alias("verdict"))
    canonical = listed.select(F.col("canonical").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")).distinct()
    keys = table_of.union(canonical)
    blocks = 1 << max(0, (max(1, keys.count()) // KEYS).bit_length())
    bloom = build_filter(keys, blocks)
    deep = sorted({h.count(".") + 1 for h, _, _ in rules})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in deep])) if deep else F.array().cast("array<string>")
    starts = F.array_distinct(F.filter(F.array(*[F.left(F.col("path"), F.lit(n)) for n in sorted({len(p) for _, p, _ in rules})]) if rules else F.array().cast("array<string>"), lambda p: p.isNotNull()))
    looked = F.concat(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, F.lit(SEPARATOR), p)))), F.array(F.concat("host", "path")))
    candidates = urls.select("host", "path", F.explode(F.array_distinct(looked)).alias("key"))
    hits = possible(candidates, bloom, blocks).join(keys, "key").select("host", "path", "rule", "verdict")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), "rule", "verdict")).alias("best"))
    found = rows.where("host != ''").join(best, ["host", "path"], "left")
    found = found.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return found.union(rows.where("host = ''").select("id", "host", "path", F.lit(None).cast("string"), F.lit("allow")))


#: Rules of the query: host, start of the path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The query's list: canonical URLs of the pages whose id this number divides.
LISTED = 50


def query(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    listed = pages.where(F.col("page_id") % LISTED == 0).select(F.concat(host, path).alias("canonical")).where("canonical != ''")
    return judge(pages, RULES, listed).withColumnRenamed("id", "page_id")


ORACLE = f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parted as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from cut
), rules(h, p, verdict) as (
  values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), fits as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from parted join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
), listed as (
  select distinct host || path as canonical from parted where page_id % {LISTED} = 0 and host || path <> ''
)
select x.page_id, x.host, x.path, f.rule, coalesce(f.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict
from parted x left join fits f using (page_id) left join listed l on l.canonical = x.host || x.path and x.host <> ''
"""
