"""The Shapiro-Wilk test in SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce


def _polynomial(x: str, coefficients: Sequence[float]) -> str:
    return reduce(lambda s, c: f"({s} * {x} + {c!r})", coefficients[1:], repr(coefficients[0]))


# Published approximations of the normal quantile, as in the tests' own tables.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _quantile(p: str) -> str:
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{q} * {_polynomial(f'({q} * {q})', _A)} / {_polynomial(f'({q} * {q})', _B)}"
    tail = f"sign(0.5 - {p}) * {_polynomial(t, _C)} / {_polynomial(t, _D)}"
    return f"CASE WHEN least({p}, 1 - {p}) >= 0.02425 THEN {middle} ELSE {tail} END"


def _upper_tail(z: str) -> str:
    """By the series of the density's integral: exact for moderate z, which is all that shows."""
    terms = f"list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) "
    terms += "- list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1)))))"
    area = f"sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum({terms})"
    return f"CASE WHEN abs({z}) > 9 THEN CASE WHEN {z} > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - {area} END"


def shapiro_sql(value: str, source: str, most: int = 5000) -> str:
    """One row: n_tested, w_statistic and normality_pvalue, for twelve values or more."""
    return f"""
    SELECT n AS n_tested, w AS w_statistic, {_upper_tail('z')} AS normality_pvalue
    FROM (
      SELECT n, w, (ln(1 - w) - ({_polynomial('ln(n)', (0.0038915, -0.083751, -0.31082, -1.5861))}))
                   / exp({_polynomial('ln(n)', (0.0030302, -0.082676, -0.4803))}) AS z
      FROM (
        SELECT n, pow(a1 * r1 + a2 * r2 + inner_sum
                      / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2)
                  / squares AS w
        FROM (
          SELECT *, m1 / sqrt(mm) + {_polynomial('(1 / sqrt(n))', (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0))} AS a1,
                 m2 / sqrt(mm) + {_polynomial('(1 / sqrt(n))', (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0))} AS a2
          FROM (
            SELECT any_value(n) AS n, sum(x * x) AS squares, sum(m * m) AS mm,
                   sum(m * x) FILTER (i > 2 AND i < n - 1) AS inner_sum,
                   max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2,
                   max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS r1,
                   max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS r2
            FROM (
              SELECT *, {_quantile('((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))')} AS m
              FROM (
                SELECT v - avg(v) OVER () AS x, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n
                FROM (
                  SELECT v, unnest(range(ceil((upto - c) / step - 0.5)::BIGINT,
                                         least(ceil(upto / step - 0.5)::BIGINT, size))) AS slot
                  FROM (
                    SELECT *, sum(c) OVER (ORDER BY h, v) AS upto, least(sum(c) OVER (), {most})::BIGINT AS size,
                           greatest(sum(c) OVER () / least(sum(c) OVER (), {most})::DOUBLE, 1.0) AS step
                    FROM (SELECT v, count(*) AS c, md5('42,' || v::VARCHAR) AS h
                          FROM (SELECT {value}::DOUBLE AS v FROM {source}) AS s
                          WHERE v IS NOT NULL GROUP BY v) AS counted
                  ) AS placed
                ) AS drawn
              ) AS ranked
            ) AS scored
          ) AS sums
        ) AS weights
      ) AS statistic
    ) AS test"""
