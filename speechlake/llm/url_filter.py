"""URL filters over dated lists, with DataFrame expressions only.

Dated list entries (added, removed, added again) become validity intervals; every capture is expanded to the few
keys that an entry could name (its host, its parent domains, its address and its parent folders) and joined as
of its fetch time. Only depths that occur in the lists make keys, so an address of any depth has as many keys as
the lists have depths. Intervals are broadcast while their counted rows and bytes stay under BROADCAST_ROWS and
BROADCAST_BYTES; beyond that the join is shuffled, captures dealt over SALTS copies of each interval so that a host
with a third of all captures is spread out.

Entries: ``domain`` names a host and all below it, however many labels either has; ``prefix`` names host and path, the
folder with all below it where it ends in a slash, else that address alone. Hosts match in any case, paths as they
stand; an address without a path is not its root folder's; ports, user names (all before the last @), queries and
fragments don't count; a host may be an IPv6 address in brackets. Hosts are held in one form in addresses and entries:
percent codes decoded, without dots at the end, full stops of other scripts as dots; backslashes are slashes, and an address may
begin with two slashes. Punycode isn't folded with the letters it stands for: list both.

Defined results: a capture without a host or fetch time is kept; events of one key, list and day apply removals
first; an addition of what is on the list, or a removal of what is not, changes nothing; repeated captures are
judged each; empty lists block nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed

#: Most intervals that are broadcast, and most bytes of their keys; copies of each interval where they aren't.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 16
#: What stands before a path: a scheme, or none before two slashes; then the authority.
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*(.*)$"


def _before_query(url: Column) -> Column:
    """An address up to its query or fragment, with slashes for backslashes."""
    return F.replace(F.regexp_extract(F.trim(url), r"(?s)^([^?#]*)", 1), F.lit("\\"), F.lit("/"))


def host_name(host: Column) -> Column:
    """The normal form of a host: lower case, decoded, full stops of other scripts as dots, none at the end."""
    decoded = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    return F.rtrim(F.translate(F.lower(decoded), "\u3002\uff0e\uff61", "..."), F.lit("."))


def host_of(url: Column) -> Column:
    """The host of an address in its normal form, null where there is none."""
    authority = F.regexp_extract(_before_query(url), _AUTHORITY, 1)
    own = F.substring_index(authority, "@", -1)
    return F.nullif(host_name(F.regexp_extract(own, r"^(\[[^\]]*\]|[^:\[]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_before_query(url), "(?s)" + _PATH, 1)


def depth_of(kind: Column, pattern: Column) -> Column:
    """How deep an entry is: labels of a domain, slashes of a folder; null for a single address."""
    slashes = F.length(pattern) - F.length(F.replace(pattern, F.lit("/"), F.lit("")))
    return F.when(kind == "domain", F.size(F.split(pattern, r"\."))).when(pattern.endswith("/"), slashes)


def keys_of(host: Column, path: Column, labels: list[int], folders: list[int]) -> Column:
    """Keys of an address: ``domain:`` with its last labels for each number in ``labels``, ``prefix:`` with its host and path up to each number of slashes in ``folders``, and whole."""
    parts, whole = F.split(host, r"\."), F.concat(host, path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    keys = [F.when(F.size(parts) >= k, F.concat(F.lit("domain:"), F.substring_index(host, ".", -k))) for k in labels]
    keys += [F.when(slashes >= k, F.concat(F.lit("prefix:"), F.substring_index(whole, "/", k), F.lit("/"))) for k in folders]
    return F.array_distinct(F.array_compact(F.array(*keys, F.concat(F.lit("prefix:"), whole))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, depth, list, valid_from, valid_to) from events (list, kind, pattern, action add or remove, dated); valid_to is null while an entry holds. Host names lose their case, paths keep it."""
    host = host_name(F.substring_index("pattern", "/", 1))
    pattern = F.when(F.col("kind") == "domain", host_name(F.col("pattern"))).otherwise(F.concat(host, F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)")))
    known = entries.where(F.col("dated").isNotNull() & F.col("pattern").isNotNull()).withColumn("pattern", pattern)
    events = known.select(F.concat_ws(":", "kind", "pattern").alias("key"), depth_of(F.col("kind"), F.col("pattern")).alias("depth"), F.col("list"), "dated", (F.col("action") == "add").alias("on"))
    daily = events.groupBy("key", "depth", "list", "dated").agg(F.max("on").alias("on"))  # removals of a day come before its additions
    w = Window.partitionBy("key", "depth", "list").orderBy("dated")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where(F.col("was") != F.col("on"))
    return changes.withColumn("valid_to", F.lead("dated").over(w)).where("on").select("key", "depth", "list", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, host, fetched, lists, blocked) of every capture (id, url, fetched): the lists with an entry active when it was fetched."""
    held = checkpointed(intervals(entries))
    # a row for each depth that the lists name
    known = held.groupBy(F.col("key").startswith("domain:").alias("domain"), "depth").agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).collect()
    labels = sorted(r["depth"] for r in known if r["domain"])
    folders = sorted(r["depth"] for r in known if not r["domain"] and r["depth"] is not None)
    small = sum(r["n"] for r in known) <= BROADCAST_ROWS and sum(r["bytes"] for r in known) <= BROADCAST_BYTES
    rows = captures.select(F.monotonically_increasing_id().alias("_at"), F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "fetched")
    rows = rows.select("_at", id_col, "host", "fetched", F.when(F.col("host").isNotNull(), keys_of(F.col("host"), F.col("path"), labels, folders)).alias("keys"))
    # a capture without keys gets one that nothing has, so that such rows don't meet in one task
    rows = rows.select("_at", id_col, "host", "fetched", F.explode_outer("keys").alias("key")).withColumn("key", F.coalesce("key", F.col("_at").cast("string")))
    right = held.select(F.col("key").alias("_key"), "list", "valid_from", "valid_to")
    match = (F.col("key") == F.col("_key")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    if small:
        right = F.broadcast(right)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)))
        right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        match = match & (F.col("_salt") == F.col("_copy"))
    found = rows.join(right, match, "left")
    whole = found.groupBy("_at").agg(F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("fetched").alias("fetched"), F.array_sort(F.collect_set("list")).alias("lists"))
    return whole.select(id_col, "host", "fetched", "lists", (F.size("lists") > 0).alias("blocked"))


#: Dated entries for the registered query (list, kind, pattern, action, day).
ENTRIES = [
    ("gambling", "domain", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "domain", "casino-win.example.com", "remove", "2024-05-15"),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-08-01"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-01-10"),
    ("pharmacy", "domain", "cheap-pills.example.com", "add", "2024-03-01"),
    ("pharmacy", "domain", "cheap-pills.example.com", "remove", "2024-03-01"),
    ("pharmacy", "domain", "cheap-pills.example.com", "remove", "2024-11-20"),
    ("spam", "domain", "free-bets.example.com", "add", "2024-06-01"),
    ("spam", "domain", "free-bets.example.com", "remove", "2024-07-01"),
    ("spam", "domain", "tionsh.example.net", "add", "2024-04-01"),
    ("spam", "domain", "tionsh.example.net", "remove", "2024-04-20"),
    ("spam", "domain", "blog.tionsh.example.com", "add", "2024-09-01"),
    ("review", "prefix", "tiontion.example.net/en/", "add", "2024-01-01"),
    ("review", "prefix", "tiontion.example.net/en/", "remove", "2024-12-01"),
    ("review", "domain", "example.org", "add", "2024-10-01"),
    ("review", "domain", "example.org", "remove", "2024-10-08"),
]
_VALUES = ",\n  ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in ENTRIES)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are pages fetched on a day of 2024 that page_id gives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))
    entries = spark.sql(f"SELECT list, kind, pattern, action, CAST(dated AS DATE) AS dated FROM VALUES {_VALUES} AS entries(list, kind, pattern, action, dated)")
    out = filter_urls(pages, entries)
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.array_join("lists", ",").alias("lists"), "blocked")


OP5_SQL = rf"""
WITH entries(list, kind, pattern, action, dated) AS (VALUES
  {_VALUES}),
plain AS (SELECT page_id, replace(split_part(split_part(trim(url), '?', 1), '#', 1), chr(92), '/') AS u FROM pages),
cut AS (SELECT page_id, u, strpos(u, '//') AS pos FROM plain),
rest AS (SELECT page_id, CASE WHEN pos = 1 OR pos > 2 AND u[pos - 1] = ':' AND u[1] BETWEEN 'A' AND 'z' AND translate(lower(left(u, pos - 2)), 'abcdefghijklmnopqrstuvwxyz0123456789+.-', '') = '' THEN u[pos + 2:] ELSE '' END AS r FROM cut),
parts AS (SELECT page_id, string_split(r, '/')[1] AS authority, r FROM rest),
named AS (SELECT page_id, string_split(authority, '@')[-1] AS a, r[length(authority) + 1:] AS path FROM parts),
hosts AS (SELECT page_id, path, nullif(rtrim(lower(url_decode(CASE WHEN a[1] = '[' THEN split_part(a, ']', 1) || ']' ELSE split_part(a, ':', 1) END)), '.'), '') AS host FROM named),
captures AS (SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched, host, path FROM hosts),
last_event AS (
  SELECT c.page_id, e.list, e.pattern, arg_max(e.action, e.dated || CASE e.action WHEN 'add' THEN '2' ELSE '1' END) AS state
  FROM captures c JOIN entries e ON CAST(e.dated AS DATE) <= c.fetched AND CASE e.kind
    WHEN 'domain' THEN c.host = e.pattern OR ends_with(c.host, '.' || e.pattern)
    ELSE c.host || c.path = e.pattern OR (ends_with(e.pattern, '/') AND starts_with(c.host || c.path, e.pattern)) END
  GROUP BY ALL)
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(l.lists, '') AS lists, l.lists IS NOT NULL AS blocked
FROM captures c LEFT JOIN (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM last_event WHERE state = 'add' GROUP BY page_id) l USING (page_id)
"""
