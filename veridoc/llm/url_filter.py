"""URL filters: a sort-merge range join over reversed hosts.

The host of a rule, its labels reversed and each ended by a dot, is a prefix of the keys of its
host and all subdomains; the prefix is an interval of keys.  URLs are sorted by their key inside each
partition, and one sweep over urls and rules together keeps a stack of the rules whose interval
holds the current key; they are nested, so the stack's order is that of their hosts' lengths.  Among the
active rules whose path starts the url's path the longest (host and path together) wins, on a tie the one with the longer
host, then block.  No url is shuffled.  Up to ``ship`` rules are shipped to the tasks; beyond that the same keys are joined
shuffled, each url by the (at most as many as its labels) suffixes of its host.

Defined cases: a null url, or one without ``://``, has an empty host and path and matches
nothing; without a matching rule the verdict is ``default``; repeated urls give repeated rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import ascii_lower, small_batches

#: Rules of the production query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path."""
    url = F.col(url_col)
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.char_length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(after, F.lit("")).alias("path"))


def sweep(rows, rules, default: str):
    """rows: (page_id, host, path) sorted by key of the host; rules: sorted by (key, path)."""
    stack: list[tuple[str, list]] = []  # (key, rules with that key, longest path first), nested
    at = 0
    for page_id, host, path in rows:
        k = key(host)
        while stack and not k.startswith(stack[-1][0]):
            stack.pop()
        while at < len(rules) and rules[at][0] <= k:
            rk = rules[at][0]
            same = []
            while at < len(rules) and rules[at][0] == rk:
                same.append(rules[at])
                at += 1
            if k.startswith(rk):
                stack.append((rk, sorted(same, key=lambda r: (-len(r[2]), r[3] != "block"))))
        best = None
        for _, same in stack:
            for _, rhost, rpath, verdict in same:
                if path.startswith(rpath):
                    if best is None or len(rhost) + len(rpath) >= len(best[0]) + len(best[1]):
                        best = (rhost, rpath, verdict)
                    break
        yield page_id, host, path, best and best[0] + best[1], best[2] if best else default


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ship: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    small_batches(pages.sparkSession, 10_000)
    rows = parts(pages, id_col, url_col)
    if len(rules) > ship:
        return filter_shuffled(rows, rules, default)
    known = sorted((key(h), h, p, v) for h, p, v in rules if h)
    reverse = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    rows = rows.withColumn("k", F.when(F.col("host") == "", "").otherwise(reverse)).sortWithinPartitions("k").drop("k")

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out = []
        for row in sweep(each(), known, default):
            out.append(row)
            if len(out) == 10_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return rows.mapInArrow(run, SCHEMA)


def pack(rows) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *[pa.array(x, pa.string()) for x in (b, c, d, e)]], ["page_id", "host", "path", "rule", "verdict"])


def filter_shuffled(rows: DataFrame, rules, default: str) -> DataFrame:
    """The same join for more rules than may be shipped: each distinct (host, path) meets the rules of its host's suffixes."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(rules), "rhost string, rpath string, v string").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rhost"))
    hit = each.join(table, "rhost").where(F.col("path").startswith(F.col("rpath")) & (F.col("rhost") != ""))
    rank = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("h"), (F.col("v") == "block").alias("b"), "rhost", "rpath", "v")
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("r"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("r.rhost", "r.rpath").alias("rule"), F.coalesce("r.v", F.lit(default)).alias("verdict"))
