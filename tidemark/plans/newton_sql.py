"""Penalised logistic fits as chained SQL tables: one per Newton step, with the same objective as models.fit_logistic."""

from __future__ import annotations

STEPS = 12


def scaled(columns: list[str], by: str = "") -> str:
    """x1, x2, ..: expressions over their rows' mean and population deviation."""
    over = f"over (partition by {by})" if by else "over ()"
    one = "(cast({c} as double) - avg(cast({c} as double)) {o}) / case when coalesce(stddev_pop(cast({c} as double)) {o}, 0) < 1e-8 then 1 else stddev_pop(cast({c} as double)) {o} end as x{i}"
    return "".join(", " + one.format(c=f"({c})", o=over, i=i + 1) for i, c in enumerate(columns))


def scaled_by(columns: list[str], train: str, by: str = "") -> str:
    """x1, x2, .. of all rows over the mean and deviation of those that meet `train`."""
    over = f"over (partition by {by})" if by else "over ()"
    one = "(cast({c} as double) - avg(cast({c} as double)) filter (where {t}) {o}) / case when coalesce(stddev_pop(cast({c} as double)) filter (where {t}) {o}, 0) < 1e-8 then 1 else stddev_pop(cast({c} as double)) filter (where {t}) {o} end as x{i}"
    return "".join(", " + one.format(c=f"({c})", o=over, t=train, i=i + 1) for i, c in enumerate(columns))


def linear(d: int, offset: bool) -> str:
    return ("o + " if offset else "") + " + ".join(["b0", *[f"b{i} * x{i}" for i in range(1, d + 1)]])


def fit(name: str, source: str, d: int, by: str = "", offset: bool = False, l2: float = 1.0) -> str:
    """Tables name_0 .. and at last `name` (by, b0 .. bd), from source (by, y, x1 .. xd, o)."""
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    on = f"using ({by})" if by else "on true"
    x = ["1", *[f"x{i}" for i in range(1, d + 1)]]
    b = ", ".join(f"b{i}" for i in range(d + 1))
    out = f", {name}_0 as (select {key}" + ", ".join(f"cast(0 as double) as b{i}" for i in range(d + 1)) + f" from {source}{group or ' limit 1'})"
    for n in range(STEPS):
        sums = [f"sum((p - y) * {x[i]}) as g{i}" for i in range(d + 1)] + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) as h{i}{j}" for i in range(d + 1) for j in range(i + 1)]
        out += f""",
{name}_g{n} as (select {key}{b}, {", ".join(sums)} from (select *, 1 / (1 + exp(-({linear(d, offset)}))) as p from {source} join {name}_{n} {on}) group by {key}{b})"""
        solve = []
        for i in range(d + 1):
            for j in range(i + 1):
                s = f"h{i}{j}" + (f" + {l2}" if i == j and i else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                solve.append(f"sqrt({s} + 1e-12) as l{i}{j}" if i == j else f"({s}) / l{j}{j} as l{i}{j}")
        for i in range(d + 1):
            solve.append(f"(g{i}" + (f" + {l2} * b{i}" if i else "") + "".join(f" - l{i}{k} * u{k}" for k in range(i)) + f") / l{i}{i} as u{i}")
        for i in reversed(range(d + 1)):
            solve.append(f"(u{i}" + "".join(f" - l{k}{i} * s{k}" for k in range(i + 1, d + 1)) + f") / l{i}{i} as s{i}")
        step = ", ".join(f"b{i} - greatest(least(s{i}, 5), -5) as b{i}" for i in range(d + 1))
        out += f""",
{name}_{n + 1} as (select {key}{step} from (select *, {", ".join(solve)} from {name}_g{n}))"""
    return out + f",\n{name} as (select * from {name}_{STEPS})"
