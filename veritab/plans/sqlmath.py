"""SQL text for the small dense algebra of fits: elimination and Newton steps, unrolled as common table expressions."""

from __future__ import annotations


LONGEST_STEP = 2.0


def solve_cte(name: str, source: str, n: int) -> str:
    """CTEs ending in ``name``: the rows of ``source`` (a_i_j, b_i, other columns) with x_i of the n equations a x = b."""
    parts, last = [], source
    for s in range(n - 1):
        terms = []
        for i in range(s + 1, n):
            f = f"a_{i}_{s} / a_{s}_{s}"
            terms += [f"a_{i}_{j} - {f} * a_{s}_{j} AS a_{i}_{j}" for j in range(s + 1, n)] + [f"b_{i} - {f} * b_{s} AS b_{i}"]
        parts.append(f"{name}_e{s} AS (SELECT * REPLACE ({', '.join(terms)}) FROM {last})")
        last = f"{name}_e{s}"
    back = []
    for i in range(n - 1, -1, -1):
        known = "".join(f" - a_{i}_{j} * x_{j}" for j in range(i + 1, n))
        back.append(f"(b_{i}{known}) / a_{i}_{i} AS x_{i}")
    parts.append(f"{name} AS (SELECT *, {', '.join(back)} FROM {last})")
    return ",\n".join(parts)


def logistic_cte(name: str, rows: str, n: int, steps: int, c: float = 1.0) -> str:
    """CTEs ending in ``name`` (k, w_0 .. w_n): logistic fits of ``rows`` (k, z_0 .. z_{n-1}, y), intercept last, by Newton steps."""
    z = [*[f"z_{i}" for i in range(n)], "1.0"]
    parts = [f"{name}_w0 AS MATERIALIZED (SELECT DISTINCT k, {', '.join(f'0.0::DOUBLE AS w_{i}' for i in range(n + 1))} FROM {rows})"]
    for t in range(steps):
        line = " + ".join(f"w_{i} * {z[i]}" for i in range(n + 1))
        sums = [f"{c} * sum(p * (1 - p) * {z[i]} * {z[j]}) + {1 if i == j < n else 0} AS a_{i}_{j}" for i in range(n + 1) for j in range(n + 1)]
        sums += [f"{c} * sum((p - y) * {z[i]}) + {f'any_value(w_{i})' if i < n else '0'} AS b_{i}" for i in range(n + 1)]
        sums += [f"any_value(w_{i}) AS w_{i}" for i in range(n + 1)]
        parts.append(f"{name}_g{t} AS MATERIALIZED (SELECT k, {', '.join(sums)} FROM (SELECT r.*, w.* EXCLUDE (k), 1 / (1 + exp(-({line}))) AS p FROM {rows} r JOIN {name}_w{t} w USING (k)) GROUP BY k)")
        parts.append(solve_cte(f"{name}_s{t}", f"{name}_g{t}", n + 1))
        # Long steps are shortened: far from the optimum a full one may overshoot.
        share = f"least(1, {LONGEST_STEP} / greatest(1e-300, {', '.join(f'abs(x_{i})' for i in range(n + 1))}))"
        parts.append(f"{name}_w{t + 1} AS MATERIALIZED (SELECT k, {', '.join(f'w_{i} - x_{i} * {share} AS w_{i}' for i in range(n + 1))} FROM {name}_s{t})")
    parts.append(f"{name} AS (SELECT * FROM {name}_w{steps})")
    return ",\n".join(parts)
