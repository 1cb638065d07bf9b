"""URL verdicts by host reputation, from labelled pages through empirical-Bayes beta-binomial priors.

A labelled page says good or bad of its host. The share of good pages is estimated level by level: the suffix, under
which registries give out names, is shrunk towards the whole table, the registered domain (one label more) towards its
suffix, the host towards its domain; a level's estimate is a beta posterior whose prior has the mean of the level above
and, as its weight in pages, the strength that the spread of that level's shares shows (method of moments). A host
is blocked if even the upper bound of its posterior, mean plus BOUND_SD standard deviations, is below LEAST_GOOD.

A suffix is the last label of a host, or the longest of `suffixes` that it ends in; that table is a parameter, carried
in the plan, so meant for some thousand entries. User part, port and closing dots belong to no label: they stay in the
host that is returned, but hosts that differ in them only share a reputation. Addresses (IPv4, or IPv6 in brackets) are
domains by themselves, under one suffix of their own.

A fixed set of rules goes before the estimate: a rule fits its host and all subdomains when the url's path starts
with the rule's path; of those that fit the longest decides.

Null urls, and urls without ://, have empty host and path; they share the reputation of the empty host. Unlabelled
hosts take their domain's, suffix's or the table's estimate; without any label that is PRIOR_GOOD and everything is
allowed. Repeated pages are judged alike, a page labelled twice counts once, as its larger label; empty tables give
an empty result. Columns other than the ids, the url and the label are not looked at.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import written

# host, path, verdict
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
LEAST_GOOD = 0.85
BOUND_SD = 1.0
PRIOR_GOOD = 0.9
# Suffixes of two labels under which registries give out names, of the countries met most often.
SUFFIXES = (
    "ac.jp ac.uk co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx "
    "com.my com.pl com.sg com.tr com.tw com.ua com.vn edu.au go.jp gov.au gov.uk ltd.uk me.uk ne.jp net.au net.uk nhs.uk "
    "or.jp org.au org.nz org.uk plc.uk sch.uk"
).split()
ADDRESSES = "[address]"
# Bounds of a prior's weight in pages.
WEAKEST, STRONGEST = 2.0, 200.0


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark or hash, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user part, port and closing dots."""
    return F.regexp_replace(host, r"^[^/]*@|:[0-9]*\z|[.]+(:[0-9]*)?\z", "")


def _last_labels(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", -n)


def domain_and_suffix(name: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """The registered domain of a host's name, and the suffix that it is registered under."""
    domain, suffix = _last_labels(name, 2), _last_labels(name, 1)
    # Longer suffixes come last, so that they are asked first.
    for n in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        known = _last_labels(name, n).isin([s for s in suffixes if s.count(".") + 1 == n])
        domain = F.when(known, _last_labels(name, n + 1)).otherwise(domain)
        suffix = F.when(known, _last_labels(name, n)).otherwise(suffix)
    address = name.rlike(r"^([0-9]+([.][0-9]+)*|\[[^/]*)\z")
    return F.when(address, name).otherwise(domain), F.when(address, F.lit(ADDRESSES)).otherwise(suffix)


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as host and path joined, or null."""
    rule = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
    return rule


def page_number(path: Column) -> Column:
    """The document a page shows: the last number that is a whole segment of the path, with or without .html."""
    return F.expr("try_cast(nullif(regexp_extract(_path, '.*/([0-9]{1,18})(?:[.]html)?/?$', 1), '') as long)")


def _counts(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """`host`, `domain`, `suffix`, `n` labelled pages and `good` ones of them."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_number"), F.col("quality").cast("int").alias("_good"))
        .where("_number is not null and _good in (0, 1)")
        .groupBy("_number")
        .agg(F.max("_good").alias("_good"))
    )
    numbered = pages.withColumn("_number", page_number(F.col("_path"))).where("_number is not null")
    seen = numbered.select("_page", name_of(F.col("_host")).alias("host"), "_number").distinct().join(known, "_number")
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    counts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("_good").alias("good"))
    return counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")


def _strength(n: Column, good: Column, mean: Column) -> Column:
    """Weight of a beta prior by the method of moments, over the groups below: n pages, good ones, the prior's mean.

    The spread of the shares beyond what counting explains is mean*(1-mean)/(weight+1) for a beta prior.
    """
    share = good / n
    spread = F.sum(n * (share - mean) * (share - mean)) / F.sum(n)
    noise = F.count(F.lit(1)) * F.max(mean * (1 - mean)) / F.sum(n)
    room = F.max(mean * (1 - mean))
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(room / between - 1, F.lit(WEAKEST)), F.lit(STRONGEST))


def reputations(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior `mean` and `weight` for hosts, domains, suffixes and the whole table.

    The labelled pages are gone through once, down to a row for each host, and each level is written down before the
    next one is shrunk towards it. Of a level only the strength of its prior, one number, comes to the driver.
    """
    hosts = written(_counts(pages, labels, suffixes), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    whole = written(
        whole.select(((F.col("good") + 2 * PRIOR_GOOD) / (F.col("n") + 2)).alias("mean"), (F.col("n") + 2.0).alias("weight")),
        "url-whole",
    )

    def shrunk(with_prior: DataFrame, name: str) -> DataFrame:
        strength = F.lit(with_prior.agg(_strength(F.col("n"), F.col("good"), F.col("prior"))).first()[0]).cast("double")
        return written(
            with_prior.select(
                name,
                ((F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)).alias("mean"),
                (F.col("n") + strength).alias("weight"),
            ),
            f"url-{name}",
        )

    suffix = shrunk(tops.withColumn("prior", F.lit(whole.first().mean)), "suffix")
    domain = shrunk(domains.join(suffix.select("suffix", F.col("mean").alias("prior")), "suffix"), "domain")
    host = shrunk(hosts.join(domain.select("domain", F.col("mean").alias("prior")), "domain"), "host")
    return host, domain, suffix, whole


def url_verdicts(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `good_mean`, `good_upper`: a row for each row of `pages`."""
    url = F.col("url").cast("string")
    judged = pages.select(F.col("page_id").cast("long").alias("_page"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    host, domain, suffix, whole = reputations(judged, labels, suffixes)
    # Each distinct host is looked up once, whatever the number of its pages.
    named = judged.select("_host").distinct()
    named = named.withColumn("_name", name_of(F.col("_host")))
    of_domain, of_suffix = domain_and_suffix(F.col("_name"), suffixes)
    named = (
        named.withColumns({"_domain": of_domain, "_suffix": of_suffix})
        .join(host.select(F.col("host").alias("_name"), F.struct("mean", "weight").alias("h")), "_name", "left")
        .join(domain.select(F.col("domain").alias("_domain"), F.struct("mean", "weight").alias("d")), "_domain", "left")
        .join(suffix.select(F.col("suffix").alias("_suffix"), F.struct("mean", "weight").alias("s")), "_suffix", "left")
        # One row, so the broadcast is bounded.
        .join(F.broadcast(whole.select(F.struct("mean", "weight").alias("w"))))
        .select("_host", F.coalesce("h", "d", "s", "w").alias("r"))
        .select(
            "_host",
            F.col("r.mean").alias("good_mean"),
            (F.col("r.mean") + BOUND_SD * F.expr("sqrt(r.mean * (1 - r.mean) / (r.weight + 1))")).alias("good_upper"),
        )
    )
    # Written down, so that the join below has plain shuffles on both sides, of which Spark can split a frequent host's.
    named = written(named, "url-estimates")
    rule = rule_of(F.col("_host"), F.col("_path"))
    ruled = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in RULES:
        ruled = F.when(F.col("rule") == rule_host + rule_path, F.lit(verdict)).otherwise(ruled)
    return (
        judged.join(named, "_host")
        .withColumn("rule", rule)
        .select(
            F.col("_page").alias("page_id"),
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            "rule",
            F.coalesce(ruled, F.when(F.col("good_upper") < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow"))).alias(
                "verdict"
            ),
            F.round("good_mean", 6).alias("good_mean"),
            F.round("good_upper", 6).alias("good_upper"),
        )
    )
