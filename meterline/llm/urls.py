"""URL verdicts from hand-written rules and from a list of domains held in a cascade of Bloom filters.

The cascade.  All keys that can be asked for are known: every domain above every host of the corpus, and the
listed keys.  Level 1 holds the listed keys; level 2 those other keys that level 1 wrongly holds; level 3 the
listed keys that level 2 wrongly holds, and so on until a level is wrong about no key.  The first level that
does not hold a key settles it - an odd one: not listed, an even one: listed - so for every key of the
universe the answer is exact.  Pages are judged by expressions over the filters' bits; nothing is joined.

DataFrame functions only: no Python worker takes part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import settle

#: Verdicts of rules (verdict, host, path): a rule fits its host and all hosts below it.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Domains that are blocked with all hosts below them where no rule fits.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
               for top in ("com", "net", "org"))
#: Bits of all levels together, as a literal of a plan: 8 MB.
MAX_BITS = 1 << 26
LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64 bits a word, *hashes* bits a key, numbered so that levels hash differently."""

    number: int
    words: tuple[int, ...]
    hashes: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(64 * len(self.words))) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded once, into a literal
        return F.forall(F.array(*self.places(key)), lambda at: F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 0))
        return answer

    @property
    def bits(self) -> int:
        return sum(64 * len(level.words) for level in self.levels)


def _fill(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A filter of *n* keys with this rate of false hits; its words are or-ed together by Spark before they leave it."""
    size = max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    empty = Level(number, (0,) * size, max(1, round(math.log2(1 / rate))))
    at = F.explode(F.array(*empty.places(F.col("key")))).alias("at")
    parts = keys.select(at).select(F.shiftright("at", 6).alias("word"), _bit(F.col("at")).alias("bit"))
    words = [0] * size
    for row in parts.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most MAX_BITS / 64 rows
        words[row.word] = row.bits
    return Level(number, tuple(words), empty.hashes)


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade for (key, listed boolean), a row per key; every answer about these keys is exact.

    The first level's rate follows the ratio of listed keys to others, the rest take one half, so all
    levels together have about 1.44 * (log2(others / listed) + 4) bits a listed key, however large the
    universe is.  More than *max_bits* is an error, raised before a filter is built: split the list.
    """
    universe = settle(universe.select("key", "listed"), "universe")
    listed, others = universe.where("listed"), universe.where("NOT listed")
    r, s = listed.count(), others.count()
    if r == 0:
        return Cascade(())
    levels: list[Level] = []
    rate, n = min(0.5, r / (math.sqrt(2) * s)) if s else 0.5, r
    for number in range(1, LEVELS + 1):
        bits = n * math.log2(1 / rate) / math.log(2)
        if bits + sum(64 * len(x.words) for x in levels) > max_bits:
            raise ValueError(f"a cascade of {r} listed among {r + s} keys needs over {max_bits} bits")
        own, rest = (listed, others) if number % 2 else (others, listed)
        for level in levels:  # only keys that no level has settled yet
            own, rest = (x.where(level.holds(F.col("key"))) for x in (own, rest))
        levels.append(_fill(own, number, n, rate))
        rate, n = 0.5, rest.where(levels[-1].holds(F.col("key"))).count()
        if n == 0:
            return Cascade(tuple(levels))
    raise RuntimeError("the levels did not settle: repeated keys that are listed and not listed")


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path): see `judge`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column, longest: int) -> Column:
    """The host and the domains above it, of at most *longest* characters each: no other can be listed.

    So a very long host costs its last *longest* characters, not their square.
    """
    whole = F.length(host) <= longest
    tail = F.when(whole, host).otherwise(F.substring(host, -(longest + 1), longest + 1))
    labels = F.split(tail, r"\.", -1)
    inner = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    labels = F.when(whole, labels).otherwise(inner)
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def ruling(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one; of equally long ones the longer host's, then the first."""
    rule = verdict = None
    for kind, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, domain + start) if rule is None else rule.when(fits, domain + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_column: str = "page_id",
          url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) of every page, one row per row of *pages*.

    The host is what stands between the first "://" and the next "/", "?", "#" or the end, A-Z lower-cased;
    the path follows up to "?", "#" or the end.  The longest fitting rule decides; without one, a page is
    blocked if its host or a domain above it is in the first column of *listed* (lower case, no null or empty
    keys; repeats count once), else allowed.  A null url, or one without "://", has an empty host and path and
    so no rule: it is allowed.  Repeated rows stay; an empty table or list is fine; extra columns are not read.

    The universe of keys is one distinct over all pages; keys meet first where they are read, so a host with
    a third of all rows sends one row a task.  Starts Spark jobs when called: one a level, over distinct keys.
    """
    host, path = parts_of(F.col(url))
    seen = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    keys = listed.select(F.col(listed.columns[0]).alias("key")).where("key IS NOT NULL AND key != ''")
    longest = keys.agg(F.max(F.length("key"))).first()[0] or 0
    if not longest:
        cascade = Cascade(())
    else:
        asked = seen.select("host").distinct().select(F.explode(domains(F.col("host"), longest)).alias("key"))
        universe = asked.select("key", F.lit(False).alias("listed")).union(keys.select("key", F.lit(True)))
        cascade = build_cascade(universe.groupBy("key").agg(F.max("listed").alias("listed")), max_bits)
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    hit = F.exists(domains(F.col("host"), longest), cascade.holds) if cascade.levels else F.lit(False)
    return seen.select(id_column, "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def listed_domains(spark: SparkSession, domains: Sequence[str] = LISTED) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, domains))).alias("domain"))


_FITS = "(host = '{0}' OR ends_with(host, '.{0}'))"
_RULED = "\n".join(
    f"    WHEN {_FITS.format(d)} AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, d, p) in
    sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2])))
SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
ruled AS (
  SELECT *, CASE
{_RULED.format(*[repr(d + p) for _, d, p in RULES])} END AS rule,
  CASE
{_RULED.format(*[repr(k) for k, _, _ in RULES])} END AS said FROM parts)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN {' OR '.join(_FITS.format(d) for d in LISTED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
