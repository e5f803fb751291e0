"""URL filters by empirical-Bayes host reputation.

Outcomes of pages (good or bad) are counted by host, added up to registered domains and
suffixes, and shrunk from the top: a suffix towards the whole, a domain towards its
suffix, a host towards its domain. Each level's beta-binomial prior has the mean of the
level above and a strength estimated from the spread among its members. A page without
a rule is blocked if the upper bound of its host's posterior, a quantile of the beta
distribution, lies below the threshold. Rules for hosts and paths come first; the longest
that fits decides.

All of it is DataFrame expressions. Counting aggregates before the shuffle; the join of
pages to hosts is a plain equi-join, whose hot keys Spark splits.

Defined results: a url that is null or lacks `://` has an empty host and path; such
pages share the empty host's reputation; a port, a user and a last dot belong to the host
but not to its domain; an address of numbers is its own domain; repeated rows give
repeated results; pages without an outcome count for nothing and still get a verdict;
input columns named like a result give way to it; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (what, rule)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labels before a country's two letters that make a suffix of two labels.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "id", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Words in a host's name that announce pages which no one would train on.
BAD_WORDS = ("ads", "adult", "bet", "bets", "casino", "lottery", "pills", "poker", "porn", "slots", "spam", "viagra", "xxx")
#: Bounds of a prior's strength and what it is where members show no spread, normal quantile of the posterior bound, least bound to be allowed.
STRENGTH, QUANTILE, LEAST = (2.0, 1000.0, 20.0), 1.6448536269514722, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"(^|[^a-z])({'|'.join(BAD_WORDS)})([^a-z]|$)"
_ADDRESS = r"^(\[.*|[0-9]{1,3}([.][0-9]{1,3}){3})$"


def split(url_column: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and what it says; null if none fits."""
    if len(rules) > 10_000:
        raise ValueError("rules are compiled into one expression; give at most 10,000")
    name = said = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, said = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(said)
    return name, said


def looks_good(html_column: str = "html", url_column: str = "url") -> Column:
    """1 or 0 for a page by itself: a bad word in its host's name, runs of symbols and
    shouting are bad. Null, as nothing is known, without a text."""
    html, host = F.col(html_column), split(url_column)[0]
    calm = 60 * F.regexp_count(html, F.lit(r"[*#$%]{3}|&amp;&amp;&amp;|!!")) <= F.length(html)
    return F.when(F.length(html) > 0, (calm & ~host.rlike(_WORDS)).cast("int"))


def reputation(outcomes: DataFrame, *, host_column: str = "host", outcome_column: str = "good") -> DataFrame:
    """(host, domain, suffix, n, mean, upper) for every host with an outcome or without."""
    name = F.regexp_replace(F.regexp_replace(F.col("host"), "^.*@", ""), "[.]*(:[0-9]*)?$", "")
    labels, plain = F.split("name", r"\."), ~F.col("name").rlike(_ADDRESS)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (k - 1)), k), ".")
    long = tail(2).rlike(f"^({'|'.join(SECOND)})[.][a-z]{{2}}$")
    suffix = F.when(plain, F.when(long, tail(2)).otherwise(tail(1))).otherwise(F.lit(""))
    domain = F.when(plain, F.when(long, tail(3)).otherwise(tail(2))).otherwise(F.col("name"))
    good = F.col(outcome_column)
    hosts = outcomes.groupBy(F.col(host_column).alias("host")).agg(F.count(good).cast("double").alias("n"), F.coalesce(F.sum(good), F.lit(0)).cast("double").alias("g"))
    hosts = hosts.withColumn("name", name).withColumn("domain", domain).withColumn("suffix", suffix).withColumn("root", F.lit(0))

    def totals(level: str, above: list[str]) -> DataFrame:
        """Counts by level, and among its members the number, and the spread around its mean."""
        return hosts.groupBy(level, *above).agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum((F.col("n") > 0).cast("double")).alias("k"), F.sum(F.when(F.col("n") > 0, F.col("g") * F.col("g") / F.col("n"))).alias("q"))

    def strength() -> Column:
        """By moments, with the hosts below as the members."""
        p = F.try_divide("g", "n")
        noise = p * (1 - p)
        more = F.try_divide("q", "n") - p * p - noise * F.try_divide("k", "n")
        return F.when((F.col("n") > 0) & (noise > 0) & (more > 0), F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.try_divide(noise, more) - 1))).otherwise(F.lit(STRENGTH[2]))

    top = totals("root", []).select("root", ((F.col("g") + 1) / (F.col("n") + 2)).alias("m0"), strength().alias("s0"))
    mid = totals("suffix", ["root"]).join(F.broadcast(top), "root")  # top is one row
    mid = mid.select("suffix", ((F.col("s0") * F.col("m0") + F.col("g")) / (F.col("s0") + F.col("n"))).alias("m1"), strength().alias("s1"))
    low = totals("domain", ["suffix"]).join(mid, "suffix")
    low = low.select("domain", ((F.col("s1") * F.col("m1") + F.col("g")) / (F.col("s1") + F.col("n"))).alias("m2"), strength().alias("s2"))
    out = hosts.join(low, "domain")
    # One page of either outcome is added, so that the posterior has one top.
    a, b = F.col("s2") * F.col("m2") + F.col("g") + 1, F.col("s2") * (1 - F.col("m2")) + F.col("n") - F.col("g") + 1
    out = out.withColumn("a", a).withColumn("b", b)
    return out.select("host", "domain", "suffix", "n", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), beta_bound("a", "b").alias("upper"))


def beta_bound(a: str, b: str) -> Column:
    """The upper bound of a beta distribution at QUANTILE, by formula 26.5.22 of Abramowitz and
    Stegun; a and b are at least 1. The mass below it is 0.95 within 0.015 where a is
    above 1.2, and up to 0.982 where a is 1."""
    return F.expr(_bound(a, b))


def _bound(a: str, b: str) -> str:
    """The same text is SQL for Spark and DuckDB."""
    h = f"(2 / (1 / (2 * {a} - 1) + 1 / (2 * {b} - 1)))"
    part = (QUANTILE**2 - 3) / 6
    w = f"(-{QUANTILE!r} * sqrt({h} + {part!r}) / {h} - (1 / (2 * {b} - 1) - 1 / (2 * {a} - 1)) * ({part + 5 / 6!r} - 2 / (3 * {h})))"
    return f"{a} / ({a} + {b} * exp(2 * {w}))"


RESULTS = ("host", "path", "rule", "verdict")


def judge(pages: DataFrame, outcome: Column, rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to pages that have url."""
    own = [c for c in pages.columns if c not in RESULTS]
    host, path = split()
    found = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"), outcome.alias("good"))
    name, said = rule(rules)
    known = reputation(found.select("host", "good")).select(F.col("host").alias("h"), "upper")
    out = found.join(known, F.col("host") == F.col("h"), "left")
    verdict = F.coalesce(said, F.when(F.col("upper") < LEAST, "block").otherwise("allow"))
    return out.select("row.*", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def op3_url_reputation(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, looks_good()).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def strength(a: str) -> str:
        p = f"{a}.g / {a}.n"
        noise = f"{p} * (1 - {p})"
        more = f"({a}.q / {a}.n - ({p}) ** 2 - {noise} * {a}.k / {a}.n)"
        found = f"least({STRENGTH[1]}, greatest({STRENGTH[0]}, {noise} / {more} - 1))"
        return f"CASE WHEN {a}.n > 0 AND {noise} > 0 AND {more} > 0 THEN {found} ELSE {STRENGTH[2]} END"

    total = "sum(n) AS n, sum(g) AS g, sum((n > 0)::INT) AS k, coalesce(sum(CASE WHEN n > 0 THEN g * g / n END), 0) AS q FROM h"
    fits = lambda text: f"(host = '{text.partition('/')[0]}' OR ends_with(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}')"
    best = sorted(RULES, key=lambda r: -len(r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in best) + " END"
    return rf"""
WITH a AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
  html FROM a),
o AS (SELECT page_id, host, path, CASE WHEN length(html) > 0 THEN (60 * len(regexp_extract_all(html, '[*#$%]{{3}}|&amp;&amp;&amp;|!!')) <= length(html) AND NOT regexp_matches(host, '{_WORDS}'))::INT END AS good FROM p),
c AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS g,
  regexp_replace(regexp_replace(host, '^.*@', ''), '[.]*(:[0-9]*)?$', '') AS name, string_split(name, '.') AS l FROM o GROUP BY host),
t AS (SELECT host, n, g, name, array_to_string(l[greatest(1, len(l) - 2):], '.') AS l3, array_to_string(l[greatest(1, len(l) - 1):], '.') AS l2, l[len(l)] AS l1 FROM c),
h AS (SELECT host, n, g, CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name WHEN regexp_matches(l2, '^({'|'.join(SECOND)})[.][a-z]{{2}}$') THEN l3 ELSE l2 END AS domain,
  CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN '' WHEN regexp_matches(l2, '^({'|'.join(SECOND)})[.][a-z]{{2}}$') THEN l2 ELSE l1 END AS suffix FROM t),
r AS (SELECT {total}),
s AS (SELECT suffix, {total} GROUP BY suffix),
d AS (SELECT domain, suffix, {total} GROUP BY domain, suffix),
r2 AS (SELECT (g + 1) / (n + 2) AS m, {strength("r")} AS s FROM r),
s2 AS (SELECT suffix, (r2.s * r2.m + s.g) / (r2.s + s.n) AS m, {strength("s")} AS s FROM s, r2),
d2 AS (SELECT domain, (s2.s * s2.m + d.g) / (s2.s + d.n) AS m, {strength("d")} AS s FROM d JOIN s2 USING (suffix)),
b AS (SELECT host, d2.s * d2.m + h.g + 1 AS a, d2.s * (1 - d2.m) + h.n - h.g + 1 AS b FROM h JOIN d2 USING (domain)),
v AS (SELECT host AS h, {_bound("a", "b")} AS upper FROM b)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN upper < {LEAST} THEN 'block' ELSE 'allow' END) AS verdict
FROM o LEFT JOIN v ON host = h
"""


OP3_SQL = _sql()
