"""Student's t in SQL, for the checks: Simpson's rule on the density, bisection on that."""

from __future__ import annotations

_STEPS = 400
_HALVINGS = 60


def central(t: str, df: str) -> str:
    """P(0 < T < t), an expression.

    In the angle atan(t / sqrt(df)) the density is a power of its cosine, smooth for any df.
    """
    end = f"atan(({t}) / sqrt({df}))"
    weight = f"CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    power = f"pow(cos({end} * i / {_STEPS}), ({df}) - 1)"
    scale = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi())"
    return (f"({scale} * {end} / {3 * _STEPS}.0 * list_sum(list_transform(range(0, {_STEPS + 1}), "
            f"lambda i: {weight} * {power})))")


def two_sided_p(t: str, df: str) -> str:
    """An expression, for 30 degrees of freedom or more: nothing is left beyond t = 40."""
    return f"CASE WHEN ABS({t}) >= 40 THEN 0.0 ELSE 1 - 2 * {central(f'ABS({t})', df)} END"


def quantiles(name: str, source: str, share: float) -> str:
    """CTE ``name`` (key, t): the quantile for every (key, df) of ``source``."""
    return f"""{name}_search AS (
  SELECT key, CAST(df AS DOUBLE) AS df, 0 AS step, CAST(0 AS DOUBLE) AS low,
         CAST(CASE WHEN df < 30 THEN 700 ELSE 10 END AS DOUBLE) AS high
  FROM {source}
  UNION ALL
  SELECT key, df, step + 1,
         CASE WHEN {central("(low + high) / 2", "df")} < {share - 0.5} THEN (low + high) / 2 ELSE low END,
         CASE WHEN {central("(low + high) / 2", "df")} < {share - 0.5} THEN high ELSE (low + high) / 2 END
  FROM {name}_search WHERE step < {_HALVINGS}),
{name} AS (SELECT key, (low + high) / 2 AS t FROM {name}_search WHERE step = {_HALVINGS})"""
