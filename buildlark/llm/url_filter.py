"""URL filter: listed rules first, then the reputation of the host, with DataFrame functions only.

Labelled pages are counted as bad or good per host, registered domain and suffix. Each level's rates
scatter around the rate of the level above it by a beta distribution whose strength is estimated
from all units of the level (the moments of the beta-binomial), so a host's posterior is its own
counts plus a prior from its domain, whose prior comes from its suffix, whose prior is the rate of
all pages. A host is blocked where the lower bound of its posterior lies above a tolerated rate.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlark.operators.ordering import salted_join
from buildlark.session import settle

#: A host is blocked if its rate of bad pages is above this with the probability that belongs to Z.
TOLERATED = 1 / 3
#: Normal quantile of 0.95.
Z = 1.6448536269514722
#: Range of a prior's strength, in pages: rates of one level scatter widely or hardly at all.
WEAKEST, STRONGEST = 2.0, 1000.0

Rule = tuple[str, str, str]  # allow or block, host, beginning of the path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``);
    both empty for NULL and for a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    own = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(own) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(own, ascii_uppercase, ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<size, host_size, action, text>`` of the longest rule that fits, NULL if none does.

    Of rules of one length the one with the longer host counts, then block before allow. Every rule
    is tried on every row, so the list should be short; rules do not come from a table."""
    none = F.lit(None).cast("struct<size:int,host_size:int,action:string,text:string>")
    found = [
        F.when(
            ((host == own) | host.endswith("." + own)) & path.startswith(start),
            F.struct(
                F.lit(len(own + start)).alias("size"), F.lit(len(own)).alias("host_size"),
                F.lit(action).alias("action"), F.lit(own + start).alias("text"),
            ),
        )
        for action, own, start in rules
    ]
    return F.array_max(F.array(none, *found))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; the host itself if it has fewer."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(units: DataFrame, around: str) -> float:
    """Pages that the prior of a level is worth, from the scatter of k of n around the column ``around``.

    (k - n m)^2 is n m (1 - m) (1 + (n - 1) r) in the mean, with r = 1 / (strength + 1)."""
    spread = F.col(around) * (1 - F.col(around))
    over = F.sum((F.col("k") - F.col("n") * F.col(around)) ** 2 - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    got = units.agg(over.alias("over"), room.alias("room")).first()
    if not got.room:
        return STRONGEST
    r = min(1 / (WEAKEST + 1), max(1 / (STRONGEST + 1), got.over / got.room))
    return 1 / r - 1


def _shrunk(mean: str, strength: float) -> Column:
    return (F.col("k") + F.lit(strength) * F.col(mean)) / (F.col("n") + F.lit(strength))


def _below(a: Column, b: Column, x: float) -> Column:
    """Normal deviate of P(rate <= x) of Beta(a, b), by cube roots of its F ratio (Paulson)."""
    p, q = F.cbrt(b * x), F.cbrt(a * (1 - x))
    return 3 * (p * (1 - 1 / (9 * b)) - q * (1 - 1 / (9 * a))) / F.sqrt(p * p / b + q * q / a)


def reputation(pages: DataFrame, outcomes: DataFrame, tolerated: float = TOLERATED) -> DataFrame:
    """``host, n, k, mean, blocked`` of every host of ``pages`` (page_id, host).

    ``outcomes`` is (page_id, bad): bad 0 or 1, or NULL for no outcome. A page counts once for its host
    however often its row comes; of several outcomes of a page the worst counts. A host without
    outcomes is judged by its domain's rate, one of a new domain by its suffix's, and so on.
    """
    worst = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = pages.where("page_id IS NOT NULL").distinct().join(worst, "page_id")
    counted = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("k"))
    hosts = pages.select("host").distinct().join(counted, "host", "left").na.fill(0, ["n", "k"])
    hosts = settle(hosts.select("*", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = settle(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = settle(domains.groupBy("suffix").agg(*sums), "suffixes")
    total = suffixes.agg(*sums).first()
    base = ((total.k or 0) + 0.5) / ((total.n or 0) + 1)

    suffixes = suffixes.withColumn("m0", F.lit(base))
    suffixes = suffixes.select("suffix", _shrunk("m0", _strength(suffixes, "m0")).alias("m1"))
    domains = settle(salted_join(domains, suffixes, ["suffix"], F.col("domain")), "domains")
    domains = domains.select("domain", _shrunk("m1", _strength(domains, "m1")).alias("m2"))
    hosts = settle(salted_join(hosts.drop("suffix"), domains, ["domain"], F.col("host")), "hosts")
    worth = _strength(hosts, "m2")
    a = F.col("k") + F.lit(worth) * F.col("m2")
    b = F.col("n") - F.col("k") + F.lit(worth) * (1 - F.col("m2"))
    return hosts.select("host", "n", "k", _shrunk("m2", worth).alias("mean"), (_below(a, b, tolerated) < -Z).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), tolerated: float = TOLERATED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url).

    A rule (action, host, beginning of the path) fits its host and all subdomains; the longest that
    fits gives the verdict, and ``rule`` is its host and path. Without one, ``rule`` is NULL and the verdict
    is block if the reputation of the host says so, else allow.

    NULL url, or one without ``://``: host and path are empty, and such rows share the empty host.
    NULL page_id: judged, without an outcome. Repeated rows give a row each and count as one page.
    Long urls are read whole. Other columns are ignored; no rows give no rows; without outcomes
    every page not under a rule is allowed as long as the prior rate of one half is not above the bound.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = reputation(rows.select("page_id", "host"), outcomes, tolerated).where("blocked").select("host", "blocked")
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = salted_join(rows, bad, ["host"], F.struct("page_id", "path"), "left")
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.text").alias("rule"), verdict.alias("verdict"))
