"""URL filters: a temporal list join (operator 8).

Dated list entries (a domain is added to a list or removed from it) become validity intervals; every
capture is held against the entries that were active when it was fetched. Of several active entries
the one with the longest domain decides, so that an exception can be listed below a blocked domain.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark as S

#: Rows of intervals or verdicts that are broadcast at most (a few dozen bytes each); larger ones are shuffled.
BROADCAST = 200_000
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a full stop at the end; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1)
    return F.lower(F.regexp_replace(found, r"\.$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, kind, category, since, until (exclusive) from entries domain, kind, category, action, day.

    An entry of action 'add' holds until the next entry of the same domain, kind and category; of two
    on one day a 'remove' is the later one, and equal entries count once. Rows with a null domain or
    day are none.
    """
    own = Window.partitionBy("domain", "kind", "category").orderBy("day", "action")
    rows = entries.select(F.lower("domain").alias("domain"), "kind", "category", "action", F.col("day").cast("date").alias("day")).where("domain is not null and day is not null").distinct()
    rows = rows.withColumn("until", F.coalesce(F.lead("day").over(own), F.lit(FOREVER).cast("date")))
    return rows.where("action = 'add' and day < until").select("domain", "kind", "category", F.col("day").alias("since"), "until")


def _small(df: DataFrame) -> DataFrame:
    """A frame that is sent to the executors if it has few rows, as counted, and shuffled otherwise."""
    df = S.stored(df)
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def verdicts(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """host, day, domain, kind, category: the deciding entry for each distinct host and day that has one."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = hosts.where("host <> '' and day is not null").distinct().select("host", "day", F.explode(suffixes).alias("domain"))
    active = asked.join(_small(intervals(entries)), "domain").where("since <= day and day < until")
    rank = F.struct(F.length("domain").alias("n"), "since", "kind", "category", "domain")
    best = active.groupBy("host", "day").agg(F.max(rank).alias("best"))
    return best.select("host", "day", "best.domain", "best.kind", "best.category")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, host, day, domain, category and blocked of every capture (columns key, url, fetched).

    domain and category are those of the deciding entry, null where none is active; blocked is true if
    that entry's kind is 'block'. A null or malformed url has an empty host, a null fetch time meets no
    entry; both are kept unblocked, as are repeated rows. Equal hosts of a day are joined once, so a
    host with a third of all captures costs a row a day; only the verdicts of listed hosts come back.
    """
    rows = captures.select(F.col(key), host(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("day"))
    found = _small(verdicts(rows.select("host", "day"), entries))
    out = rows.join(found, ["host", "day"], "left")
    return out.select(key, "host", "day", "domain", "category", (F.coalesce(F.col("kind") == "block", F.lit(False))).alias("blocked"))


def standard_entries() -> list[tuple[str, str, str, str, str]]:
    """A small dated list: domains of six kinds that come, go and return, exceptions, and one large host."""
    day = lambda n: str(datetime.date(2024, 1, 15) + datetime.timedelta(n))
    out = []
    for i, (name, category) in enumerate([("casino-win", "gambling"), ("free-bets", "gambling"), ("ads-track", "ads"), ("cheap-pills", "pharma"), ("spam-farm", "spam"), ("adult-x", "adult")]):
        for j, top in enumerate(("com", "net", "org")):
            n, domain = 17 * (3 * i + j), f"{name}.example.{top}"
            out.append((domain, "block", category, "add", day(n)))
            if j != 1:
                out.append((domain, "block", category, "remove", day(n + 200)))
            if j == 2:
                out.append((domain, "block", category, "add", day(n + 260)))
        out.append((f"m.{name}.example.com", "allow", "appeal", "add", day(50 + 30 * i)))
    out += [("tionsh.example.net", "block", "spam", "add", day(100)), ("tionsh.example.net", "block", "spam", "remove", day(160)), ("blog.tionsh.example.com", "block", "spam", "add", day(300))]
    return out


#: The pages have no fetch time; this one is made from their ids: one of 730 days.
FETCHED = "date_add(date'2024-01-01', cast(pmod(page_id * 37, 730) as int))"


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(standard_entries(), "domain string, kind string, category string, action string, day string")
    pages = S.read(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    return judge(pages, entries)


SQL = rf"""
WITH entries(domain, kind, category, action, day) AS (
  SELECT domain, kind, category, action, day::DATE FROM (VALUES {', '.join(map(str, standard_entries()))}) t(domain, kind, category, action, day)),
spans AS (
  SELECT domain, kind, category, action, day AS since,
         coalesce(lead(day) OVER (PARTITION BY domain, kind, category ORDER BY day, action), DATE '{FOREVER}') AS until
  FROM entries),
captures AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)) AS host,
         (DATE '2024-01-01' + CAST(((page_id * 37) % 730 + 730) % 730 AS INTEGER)) AS day
  FROM pages),
active AS (
  SELECT page_id, domain, kind, category,
         row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, since DESC, kind DESC, category DESC) AS n
  FROM captures JOIN spans ON action = 'add' AND (host = domain OR ends_with(host, '.' || domain)) AND since <= captures.day AND captures.day < until)
SELECT page_id, host, captures.day AS day, domain, category, coalesce(kind = 'block', false) AS blocked
FROM captures LEFT JOIN (SELECT * FROM active WHERE n = 1) USING (page_id)"""
