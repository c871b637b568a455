"""The isolation forest in SQL: sampling, tree growth level by level, and scoring."""

from __future__ import annotations

from collections.abc import Sequence

TREES, MAX_SAMPLES, SEED, LEVELS = 100, 256, 42, 8


def _draw(what: str) -> str:
    """A number in [0, 1): 52 bits of the MD5 of the seed, the tree, the node and `what`."""
    text = f"'{SEED},' || tree || ',' || node || ',{what}'"
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496::DOUBLE"


def _average_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
        f"ELSE 2 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} END"
    )


def _grown(features: Sequence[str]) -> str:
    """CTEs up to `nodes`, and `points`: the scaled features of every row."""
    xs = [f"x{i}" for i in range(len(features))]
    each = lambda form: ", ".join(form.format(x=x, f=f) for x, f in zip(xs, features))
    parts = [
        f"medians AS (SELECT {each('median({f})::DOUBLE AS m{x}')} FROM src)",
        f"filled AS MATERIALIZED (SELECT rid, {each('coalesce({f}::DOUBLE, m{x}) AS {x}')} "
        "FROM src, medians)",
        f"moments AS (SELECT {each('avg({x}) AS a{x}, coalesce(nullif(stddev_pop({x}), 0), 1) AS s{x}')} "
        "FROM filled)",
        f"points AS MATERIALIZED (SELECT rid, {each('({x} - a{x}) / s{x} AS {x}')} FROM filled, moments)",
        f"shape AS (SELECT n, sample, least(n, {TREES} * sample) AS size, greatest(n / "
        f"least(n, {TREES} * sample)::DOUBLE, 1.0) AS step FROM (SELECT count(*) AS n, "
        f"least(count(*), {MAX_SAMPLES}) AS sample FROM filled) AS c)",
        f"counted AS (SELECT {', '.join(xs)}, count(*) AS c, md5('{SEED},' || "
        + " || ',' || ".join(f"{x}::VARCHAR" for x in xs)
        + f") AS h FROM filled GROUP BY {', '.join(xs)})",
        f"placed AS (SELECT *, sum(c) OVER (ORDER BY h, {', '.join(xs)}) AS upto FROM counted)",
        f"slots AS (SELECT {', '.join(xs)}, unnest(range(ceil((upto - c) / step - 0.5)::BIGINT, "
        "least(ceil(upto / step - 0.5)::BIGINT, size))) AS slot FROM placed, shape)",
        # Many rows: every hundredth slot. Few: each tree draws from all.
        f"drawn AS (SELECT slots.*, tree, row_number() OVER (PARTITION BY tree ORDER BY "
        f"md5('{SEED},' || tree || ',' || slot), slot) AS place "
        f"FROM slots, (SELECT unnest(range({TREES})) AS tree) AS t, shape "
        f"WHERE n < {TREES} * sample OR slot % {TREES} = tree)",
        f"level0 AS MATERIALIZED (SELECT tree, 0 AS node, {each('({x} - a{x}) / s{x} AS {x}')} "
        f"FROM drawn, shape, moments WHERE place <= sample OR n >= {TREES} * sample)",
    ]
    lists = {k: "[" + ", ".join(k + x if k != "v" else x for x in xs) + "]" for k in ("lo", "hi", "v")}
    usable = ", ".join(f"CASE WHEN hi{x} > lo{x} THEN {i + 1} END" for i, x in enumerate(xs))
    for d in range(LEVELS + 1):
        parts += [
            f"ends{d} AS (SELECT *, count(*) OVER w AS size, "
            f"{each('min({x}) OVER w AS lo{x}, max({x}) OVER w AS hi{x}')} "
            f"FROM level{d} WINDOW w AS (PARTITION BY tree, node))",
            f"usable{d} AS (SELECT ends{d}.*, list_filter([{usable}], lambda i: i IS NOT NULL) AS u, "
            f"ceil(log2(greatest(sample, 2))) > {d} AS may FROM ends{d}, shape)",
            f"picked{d} AS (SELECT *, CASE WHEN may AND len(u) > 0 "
            f"THEN u[1 + floor({_draw('feature')} * len(u))::BIGINT] END AS pick FROM usable{d})",
            f"cut{d} AS MATERIALIZED (SELECT *, {lists['v']}[pick] AS v, {lists['lo']}[pick] + "
            f"({_draw('cut')}) * ({lists['hi']}[pick] - {lists['lo']}[pick]) AS cut FROM picked{d})",
            f"level{d + 1} AS (SELECT tree, 2 * node + 1 + (v > cut)::INTEGER AS node, {', '.join(xs)} "
            f"FROM cut{d} WHERE pick IS NOT NULL)",
        ]
    rows = " UNION ALL ".join(
        f"SELECT DISTINCT tree, node, coalesce(pick - 1, -1) AS feature, coalesce(cut, 0.0) AS threshold, "
        f"size, {d} AS depth FROM cut{d}"
        for d in range(LEVELS + 1)
    )
    parts.append(f"nodes AS MATERIALIZED ({rows})")
    return ",\n".join(parts)


def nodes_sql(source: str, features: Sequence[str]) -> str:
    return f"""
    SELECT *, CASE WHEN feature >= 0 THEN 2 * node + 1 ELSE -1 END AS left,
           CASE WHEN feature >= 0 THEN 2 * node + 2 ELSE -1 END AS right
    FROM (WITH src AS (SELECT *, row_number() OVER () AS rid FROM {source}),
    {_grown(features)}
    SELECT * FROM nodes) AS n"""


def scores_sql(source: str, features: Sequence[str], contamination: float) -> str:
    """Every row walks every tree; its mean leaf gives the score, its rank the flag."""
    values = "[" + ", ".join(f"x{i}" for i in range(len(features))) + "]"
    walk = [f"at0 AS (SELECT rid, {values} AS x, unnest(range({TREES})) AS tree, 0 AS node FROM points)"]
    for d in range(LEVELS):
        walk.append(
            f"at{d + 1} AS (SELECT rid, x, tree, CASE WHEN feature >= 0 THEN 2 * node + 1 + "
            f"(x[feature + 1] > threshold)::INTEGER ELSE node END AS node "
            f"FROM at{d} JOIN nodes USING (tree, node))"
        )
    return f"""
    SELECT *, score > cut AS is_anomaly, score - cut AS anomaly_score,
           (score - lo) / nullif(hi - lo, 0) AS anomaly_score_normalized
    FROM (WITH src AS (SELECT *, row_number() OVER () AS rid FROM {source}),
    {_grown(features)},
    {", ".join(walk)},
    scored AS MATERIALIZED (
        SELECT rid, round(pow(2.0, -avg(depth + {_average_path("size")}) /
               (SELECT {_average_path("sample")} FROM shape)), 10) AS score
        FROM at{LEVELS} JOIN nodes USING (tree, node) GROUP BY rid)
    SELECT src.*, score, (SELECT quantile_cont(score, {1 - contamination!r}) FROM scored) AS cut,
           (SELECT min(score) FROM scored) AS lo, (SELECT max(score) FROM scored) AS hi
    FROM src JOIN scored USING (rid)) AS s"""


def importance_sql(source: str, features: Sequence[str]) -> str:
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    return f"""
    SELECT {names}[feature + 1] AS feature, sum(size) / sum(sum(size)) OVER () AS importance
    FROM ({nodes_sql(source, features)}) AS n WHERE feature >= 0 GROUP BY feature"""
