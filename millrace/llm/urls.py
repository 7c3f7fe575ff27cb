"""URL filters: policy rules by host and path, then a list of unwanted pages behind a blocked Bloom filter.

A URL is judged by the longest policy rule that fits it. A URL without a rule
is blocked if its canonical form is listed. The list is turned into a blocked
Bloom filter: a key sets one bit in each of the eight 64-bit words of one
block. The filter is small and sent to every task, where it passes the
possible hits; only these are shuffled, to an exact hash join with the list
that removes false positives. All of it is DataFrame functions.

The filter has 16 bits or more a key up to ``MOST_BLOCKS`` blocks (8 MB). A
longer list fills it and more URLs reach the exact join; the verdicts are the
same.

Canonical form: user, leading ``www.`` or ``m.``, port 80 or 443 and final
dots of the host are dropped; the path loses repeated and final slashes and a
final ``.html`` or ``index.html``; parameters that track visitors are dropped
and the others sorted; scheme and fragment are dropped.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
canonical form, fits no rule and is allowed; so is one with an empty host that
is not listed. Rules of equal length: the one with the longer host. Null and
repeated rows of the list count once or not at all. Repeated pages are judged
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written

WORDS = 8
BITS_A_KEY = 16
MOST_BLOCKS = 1 << 17
#: Policy rules are written by hand; long lists belong into the listed table.
MOST_RULES = 1000

#: Query parameters that name a visit, not a page (fixed values).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|\z)"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


#: The policy of the query (fixed values).
POLICY = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"(?s)^.*@|\.*(:(80|443)?)?\z", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), r"(/index)?(\.html)?/?\z", "")
    asked = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compared with every URL, list URLs instead")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    known = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in ordered])
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocks_for(keys: int) -> int:
    """A power of two with ``BITS_A_KEY`` bits or more for each key, at most ``MOST_BLOCKS``."""
    return min(MOST_BLOCKS, 1 << max(0, -(-keys * BITS_A_KEY // (64 * WORDS)) - 1).bit_length())


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)``: a row for each block that holds a key; bits are merged before the shuffle."""
    return keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = POLICY, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, canonical, possible)`` per page; ``listed`` has one column of URLs.

    possible says whether the filter passed the page to the exact join.
    """
    of = F.col(listed.columns[0])
    keys = written(listed.select(canonical(of).alias("key")).where("key is not null").distinct(), "listed")
    blocks = blocks_for(keys.count())
    bits = written(bloom(keys, "key", blocks), "bloom")  # at most MOST_BLOCKS rows
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    ruled = read.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    at = F.when(F.col("fit").isNull(), _block(F.col("canonical"), blocks))
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    probed = ruled.withColumn("at", at).join(F.broadcast(bits), F.col("at") == F.col("block"), "left").withColumn("possible", F.coalesce(hit, F.lit(False)))
    own = [F.col("page_id"), F.col("host"), F.col("path"), F.col("fit")["rule"].alias("rule")]
    settled = probed.where(~F.col("possible")).select(*own, F.coalesce(F.col("fit")["verdict"], F.lit("allow")).alias("verdict"), "canonical", "possible")
    exact = probed.where("possible").join(keys, F.col("canonical") == F.col("key"), "left")
    return settled.unionByName(exact.select(*own, F.when(F.col("key").isNotNull(), "block").otherwise("allow").alias("verdict"), "canonical", "possible"))


#: Runs of symbols that fill pages of no use (fixed value), and how many make a page junk.
NOISE = r"%%%|###|\*\*\*|\$\$\$"
JUNK_FROM = 10


def junk(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """URLs of pages that are filled with symbols."""
    return pages.where(F.regexp_count(F.col(html_col), F.lit(NOISE)) >= JUNK_FROM).select(F.col(url_col).alias("url"))
