"""URL filters: prefix rules, and trust spread over the host graph for the rest.

Hosts whose pages a rule allows are trusted seeds, those with blocked pages are
distrusted ones, each by its share of such pages. Personalised PageRank carries
trust along the edges between hosts and distrust against them. A host is
blocked if its distrust exceeds its trust by more than the threshold allows.
Edges are links to other hosts, and the tie between a host and the closest
parent domain that also has pages. All in DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.scale import written
from tallywatch.llm.common import col

# (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ROUNDS = 10
# Blocked from this share of distrust in the sum of trust and distrust.
THRESHOLD = 0.5
SHARE_DIGITS = 9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule).otherwise(found)
    return found


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts.

    `pages` has host and html, `hosts` the distinct hosts as column host.
    """
    links = (
        pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
        .select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    parts = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("up")),
    )
    above = hosts.where(F.size(parts) > 1).select("host", F.explode(parents).alias("p"))
    known = hosts.select(F.col("host").alias("up"))
    ties = (
        above.select("host", "p.cut", "p.up")
        .join(known, "up")
        .groupBy("host")
        .agg(F.min_by("up", "cut").alias("up"))
    )
    one = F.lit(1.0).alias("weight")
    ties = ties.select(F.col("host").alias("src"), F.col("up").alias("dst"), one).unionAll(
        ties.select(F.col("up").alias("src"), F.col("host").alias("dst"), one)
    )
    every = links.unionAll(ties).where("src != dst and src != '' and dst != ''")
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """(host, trust, distrust) after `rounds` rounds from the seed shares.

    `seeds` has host, trust and distrust; only hosts reached from a seed are
    returned. Each round is stored, so a lost executor costs one round.
    """
    out = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("all_out"))
    into = edges.groupBy(F.col("dst").alias("d")).agg(F.sum("weight").alias("all_in"))
    shares = written(
        edges.join(out, edges.src == F.col("s")).join(into, edges.dst == F.col("d")).select(
            "src",
            "dst",
            (F.col("weight") / F.col("all_out")).alias("forward"),
            (F.col("weight") / F.col("all_in")).alias("backward"),
        ),
        "host-edges",
    )
    base = seeds.select(
        "host",
        ((1 - damping) * F.col("trust")).alias("trust"),
        ((1 - damping) * F.col("distrust")).alias("distrust"),
    )
    ranks, zero = seeds, F.lit(0.0)
    for _ in range(rounds):
        trust = shares.join(ranks, shares.src == ranks.host).select(
            F.col("dst").alias("host"),
            (damping * F.col("trust") * F.col("forward")).alias("trust"),
            zero.alias("distrust"),
        )
        distrust = shares.join(ranks, shares.dst == ranks.host).select(
            F.col("src").alias("host"),
            zero.alias("trust"),
            (damping * F.col("distrust") * F.col("backward")).alias("distrust"),
        )
        ranks = written(
            base.unionAll(trust)
            .unionAll(distrust)
            .groupBy("host")
            .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")),
            "ranks",
        )
    return ranks


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of `pages`.

    The longest rule that fits decides; other pages get their host's verdict.
    Hosts that neither trust nor distrust reaches are allowed, and so are rows
    without a host. Null html has no links. Repeated rows are judged alike; each
    counts as a page of its host.
    """
    host, path = host_of(col(url_col)), path_of(col(url_col))
    base = pages.select(
        col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), col(html_col).alias("html")
    )
    judged = base.select(
        "page_id", "host", "path", apply_rules(F.col("host"), F.col("path"), rules).alias("fit")
    )
    allowed, blocked = (F.count_if(F.col("fit.verdict") == v) for v in ("allow", "block"))
    hosts = written(
        judged.where("host != ''")
        .groupBy("host")
        .agg(allowed.alias("allowed"), blocked.alias("blocked")),
        "hosts",
    )
    total = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = hosts.select(
        "host",
        (F.col("allowed") / F.lit(float(total[0] or 1))).alias("trust"),
        (F.col("blocked") / F.lit(float(total[1] or 1))).alias("distrust"),
    )
    edges = written(host_edges(base.select("host", "html"), hosts.select("host")), "edges")
    ranks = written(spread(seeds, edges, damping, rounds), "host-trust")
    out = judged.join(ranks, "host", "left")
    share = F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    # Rounded, so that the order of a sum cannot turn a tie.
    own = F.when(F.round(share, SHARE_DIGITS) > threshold, "block").otherwise("allow")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def sql(rounds: int = ROUNDS) -> str:
    """The verdicts of `judge_urls` with its defaults, in DuckDB's SQL."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}')"
        for _, name, prefix in rules
    ]
    cases = {
        "rule": [f"WHEN {f} THEN '{n + p}'" for f, (_, n, p) in zip(fits, rules)],
        "fit": [f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules)],
    }
    judged = ", ".join(f"CASE {' '.join(c)} END AS {n}" for n, c in cases.items())
    link = _LINK.replace("'", "''")
    steps = "".join(
        f""",
r{k} AS MATERIALIZED (
    SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
        SELECT host, (1 - {DAMPING}::DOUBLE) * trust AS trust,
            (1 - {DAMPING}::DOUBLE) * distrust AS distrust FROM r0
        UNION ALL SELECT dst, {DAMPING}::DOUBLE * trust * forward, 0.0
        FROM shares JOIN r{k - 1} ON src = host
        UNION ALL SELECT src, 0.0, {DAMPING}::DOUBLE * distrust * backward
        FROM shares JOIN r{k - 1} ON dst = host)
    GROUP BY host)"""
        for k in range(1, rounds + 1)
    )
    return rf"""
WITH parts AS (
    SELECT page_id, html, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
        translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host
    FROM pages),
judged AS MATERIALIZED (SELECT page_id, host, path, html, {judged} FROM parts),
hosts AS MATERIALIZED (
    SELECT host, count(*) FILTER (fit = 'allow') AS allowed, count(*) FILTER (fit = 'block') AS blocked
    FROM judged WHERE host <> '' GROUP BY host),
links AS (
    SELECT src, dst, count(*)::DOUBLE AS weight FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)),
            '{_UPPER}', '{_LOWER}') AS dst FROM judged)
    GROUP BY src, dst),
cut AS (SELECT host, string_split(host, '.') AS p FROM hosts),
above AS (
    SELECT host, i, array_to_string(p[i:], '.') AS up
    FROM (SELECT host, p, unnest(range(2, len(p) + 1)) AS i FROM cut)),
ties AS (
    SELECT a.host, arg_min(a.up, a.i) AS up FROM above a JOIN hosts h ON a.up = h.host GROUP BY a.host),
edges AS MATERIALIZED (
    SELECT src, dst, sum(weight) AS weight FROM (
        FROM links UNION ALL SELECT host, up, 1.0::DOUBLE FROM ties
        UNION ALL SELECT up, host, 1.0::DOUBLE FROM ties)
    WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
shares AS MATERIALIZED (
    SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS forward,
        weight / sum(weight) OVER (PARTITION BY dst) AS backward FROM edges),
r0 AS MATERIALIZED (
    SELECT host, allowed / greatest(sum(allowed) OVER (), 1)::DOUBLE AS trust,
        blocked / greatest(sum(blocked) OVER (), 1)::DOUBLE AS distrust FROM hosts){steps},
spread AS (SELECT host, distrust / nullif(trust + distrust, 0) AS share FROM r{rounds})
SELECT page_id, host, path, rule,
    coalesce(fit, CASE WHEN round(share, {SHARE_DIGITS}) > {THRESHOLD} THEN 'block' ELSE 'allow' END)
        AS verdict,
    round(share, 6) AS distrust_share
FROM judged LEFT JOIN spread USING (host)
"""
