"""SQL text of models and distributions, for the statements that queries are held against.

Integrals are Simpson sums; logistic models are Newton steps in a recursive CTE.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

Entries = dict[tuple[int, int], str]


def integral(f: str, upto: str, steps: int = 400) -> str:
    """The integral over @, the variable of `f`, from 0 to `upto`."""
    weight = f"CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(({upto}) * j / {steps}.0)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda j: ({weight}) * ({f.replace('@', at)}))) * ({upto}) / {3 * steps}.0)"


def normal_p(z: str) -> str:
    """Two-sided tail of a normal variable."""
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0, 1 - 2 * {integral('exp(-0.5 * @ * @)', f'abs({z})')} / sqrt(2 * pi())) END"


def t_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t."""
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0, 1 - 2 * {front} * {integral(f'pow(1 + @ * @ / ({df}), -(({df}) + 1) / 2.0)', f'abs({t})')}) END"


def chi2_p(x: str, df: str) -> str:
    """Upper tail of a chi-square variable, as the tail of its root."""
    f = f"CASE WHEN ({df}) = 1 THEN 1 ELSE pow(@, ({df}) - 1) END * exp(-0.5 * @ * @)"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, 1 - 2 * {integral(f, f'sqrt({x})')} / (pow(2, ({df}) / 2.0) * exp(lgamma(({df}) / 2.0)))) END"


def chi2_of_p(name: str, rows: str, keys: Sequence[str], p: str = "p") -> str:
    """CTE with keys and chi2, the chi-square (one degree of freedom) with upper tail `p`, by bisection on its root."""
    k = ", ".join(keys)
    return f"""{name}_b AS (SELECT {k}, {p} AS goal, 0 AS i, 0.0::DOUBLE AS lo, 12.0::DOUBLE AS hi FROM {rows} UNION ALL
  SELECT {k}, goal, i + 1, CASE WHEN tail > goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > goal THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {normal_p('(lo + hi) / 2')} AS tail FROM {name}_b WHERE i < 60) z),
{name} AS (SELECT {k}, lo * lo AS chi2 FROM {name}_b WHERE i = 60)"""


def determinant(m: Sequence[Sequence[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: [row[:j] + row[j + 1 :] for row in map(list, m[1:])]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {determinant(minor(j))}" for j in range(len(m))).removeprefix("+ ") + ")"


def inverse(h: Entries, det: str, n: int = 4) -> Entries:
    """Entries (i <= j) of the inverse of a symmetric matrix with entries `h` and determinant `det`."""
    out = {}
    for i, j in itertools.combinations_with_replacement(range(n), 2):
        m = [[h[min(r, c), max(r, c)] for c in range(n) if c != j] for r in range(n) if r != i]
        out[i, j] = f"({'-' if (i + j) % 2 else ''}{determinant(m)} / {det})"
    return out


def whole(h: Entries, n: int = 4) -> list[list[str]]:
    return [[h[min(i, j), max(i, j)] for j in range(n)] for i in range(n)]


X = ("1", "g", "a", "x")
PAIRS = list(itertools.combinations_with_replacement(range(4), 2))


def logistic(name: str, keys: Sequence[str], source: str, firth: bool = False) -> str:
    """CTEs that end in `name` (keys, n, beta, se, z, status): case ~ dosage + age / 50 + sex for each of keys, of rows of `source` (dosage, age, sex, y_bin).

    The steps follow the same rules as the fits they are held against: the deviance ends plain
    fits, and where no finite error comes out, penalised ones stand in (with `firth`).
    """
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    of = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    h = {p: f"h{p[0]}{p[1]}" for p in PAIRS}
    inv = {p: f"v{p[0]}{p[1]}" for p in PAIRS}
    z = lambda b: f"greatest(-30, least(30, {b}0 + {b}1 * g + {b}2 * a + {b}3 * x))"
    moments = lambda w: ", ".join(f"sum({w} * {X[i]} * {X[j]}) AS h{i}{j}" for i, j in PAIRS)
    step = [" + ".join(f"{inv[min(i, j), max(i, j)]} * u{j}" for j in range(4)) for i in range(4)]

    def steps(label: str, start: str, rounds: int, penalty: bool) -> str:
        pick = "any_value(i) AS i, any_value(dev) AS dev, " + ", ".join(f"any_value(b{i}) AS b{i}" for i in range(4))
        first = f"SELECT l.*, i, dev, b0, b1, b2, b3, 1 / (1 + exp(-{z('b')})) AS p FROM {name}_c l JOIN {label} s ON {on('l', 's')} WHERE NOT s.done AND s.i < {rounds}"
        first = f"SELECT *, n * p * (1 - p) AS w FROM ({first}) a1"
        score = "c - n * p"
        sums = f"SELECT {k}, {pick}, {moments('w')}, {', '.join(f'sum(({score}) * {X[i]}) AS u{i}' for i in range(4))} FROM ({first}) a2 GROUP BY {k}"
        inverted = f"SELECT *, {', '.join(f'{e} AS {inv[p]}' for p, e in inverse(h, 'det').items())} FROM (SELECT *, {determinant(whole(h))} AS det FROM ({sums}) a3) a4 WHERE det <> 0"
        if penalty:
            hat = " + ".join(f"{X[i]} * {X[j]} * m.{inv[min(i, j), max(i, j)]}" for i in range(4) for j in range(4))
            rows = f"SELECT f.*, c - n * p + w * ({hat}) * (0.5 - p) AS e FROM ({first}) f JOIN ({inverted}) m ON {on('f', 'm')}"
            sums = f"SELECT {k}, {', '.join(f'sum(e * {X[i]}) AS u{i}' for i in range(4))} FROM ({rows}) b1 GROUP BY {k}"
            inverted = f"SELECT m.* EXCLUDE (u0, u1, u2, u3), q.u0, q.u1, q.u2, q.u3 FROM ({inverted}) m JOIN ({sums}) q ON {on('m', 'q')}"
        moved = f"SELECT {k}, i, dev, {', '.join(f'd{i}, b{i} + ' + (f'greatest(-5, least(5, d{i}))' if penalty else f'd{i}') + f' AS n{i}' for i in range(4))} FROM (SELECT *, {', '.join(f'{s} AS d{i}' for i, s in enumerate(step))} FROM ({inverted}) c1) c2"
        rows = f"SELECT l.*, i, dev, d0, d1, d2, d3, n0, n1, n2, n3, greatest(1e-15, least(1 - 1e-15, 1 / (1 + exp(-{z('n')})))) AS q FROM {name}_c l JOIN ({moved}) s ON {on('l', 's')}"
        last = f"SELECT {k}, any_value(i) AS i, any_value(dev) AS dev, {', '.join(f'any_value(n{i}) AS b{i}, any_value(abs(d{i})) AS d{i}' for i in range(4))}, -2 * sum(c * ln(q) + (n - c) * ln(1 - q)) AS now, {moments('n * q * (1 - q)')} FROM ({rows}) d1 GROUP BY {k}"
        done = "greatest(d0, d1, d2, d3) < 1e-8" if penalty else "abs(now - dev) < 1e-8 * (abs(now) + 0.1)"
        error = f"CASE WHEN det > 0 THEN sqrt({inverse(h, 'det')[1, 1]}) END"
        return f"""{label} AS (SELECT {k}, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 1e300::DOUBLE AS dev, FALSE AS done, NULL::DOUBLE AS se FROM {start} UNION ALL
  SELECT {k}, i + 1, b0, b1, b2, b3, now, {done}, {error} FROM (SELECT *, {determinant(whole(h))} AS det FROM ({last}) e1) e2),
{label}_d AS (SELECT {k}, b1 AS beta, se FROM {label} WHERE done AND se < 1e3)"""

    parts = [
        f"{name}_c AS (SELECT {k}, dosage AS g, age / 50.0 AS a, sex AS x, count(*)::DOUBLE AS n, sum(y_bin)::DOUBLE AS c FROM {source} WHERE dosage IS NOT NULL GROUP BY {k}, dosage, age, sex)",
        f"{name}_m AS (SELECT {k}, sum(n)::BIGINT AS n, CASE WHEN max(g) <= min(g) THEN 'constant' WHEN sum(c) = 0 OR sum(c) = sum(n) THEN 'one_class' ELSE 'model_error' END AS status FROM {name}_c GROUP BY {k})",
        steps(f"{name}_p", f"(SELECT * FROM {name}_m WHERE status = 'model_error') o", 25, False),
    ]
    found = f"SELECT *, 'plain' AS how FROM {name}_p_d"
    if firth:
        parts.append(steps(f"{name}_f", f"(SELECT * FROM {name}_m m WHERE status = 'model_error' AND NOT EXISTS (SELECT 1 FROM {name}_p_d d WHERE {on('d', 'm')})) o", 100, True))
        found += f" UNION ALL SELECT *, 'firth' AS how FROM {name}_f_d"
    parts.append(f"{name} AS (SELECT {of('m')}, m.n, f.beta, f.se, f.beta / f.se AS z, coalesce(f.how, m.status) AS status FROM {name}_m m LEFT JOIN ({found}) f ON {on('m', 'f')})")
    return ",\n".join(parts)


def least_squares(name: str, source: str, keys: Sequence[str] = (), p: int = 4) -> str:
    """CTE `name` (keys, n, b0.., sse, sst, r2, r2_adj) of the rows of `source` (keys, n, yy, sum_y, t_i, s_ij)."""
    h = {q: f"s_{q[0]}{q[1]}" for q in PAIRS}
    inv = inverse(h, "det")
    beta = [" + ".join(f"{inv[min(i, j), max(i, j)]} * t_{j}" for j in range(4)) for i in range(4)]
    fitted = " + ".join(f"b{i} * t_{i}" for i in range(4))
    k = "".join(f"{x}, " for x in keys)
    return f"""{name} AS (SELECT {k}n, b0, b1, b2, b3, sse, sst, 1 - sse / sst AS r2, 1 - (sse / (n - {p})) / (sst / (n - 1)) AS r2_adj FROM
  (SELECT *, yy - ({fitted}) AS sse, yy - sum_y * sum_y / n AS sst FROM (SELECT *, {', '.join(f'{b} AS b{i}' for i, b in enumerate(beta))} FROM (SELECT *, {determinant(whole(h))} AS det FROM {source}) x) y) z)"""


def significant(x: str, digits: int = 6) -> str:
    """`x` with `digits` decimals, or from 100 on five digits: what two engines agree on for values of any size."""
    return f"CASE WHEN abs({x}) < 100 THEN round({x}, {digits}) + 0.0 ELSE printf('%.4e', {x})::DOUBLE END"


def jacobi(name: str, source: str, keys: Sequence[str], sweeps: int = 10, n: int = 4) -> str:
    """CTE `name` (keys, l0.., v00..): eigenvalues and vectors (column k belongs to lk) of the symmetric matrices h_ij (i <= j) of `source`.

    Cyclic Jacobi rotations, a sweep over all places a step; those of 4x4 matrices are exact to the last digits after six sweeps or so.
    """
    k = ", ".join(keys)
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    h_all = [h(i, j) for i, j in itertools.combinations_with_replacement(range(n), 2)]
    v_all = [f"v{i}{j}" for i in range(n) for j in range(n)]
    rows = f"SELECT * FROM {name}_j WHERE sweep < {sweeps}"
    for p, q in itertools.combinations(range(n), 2):
        a, b, c = h(p, p), h(q, q), h(p, q)
        half = f"(({b} - {a}) / (2 * {c}))"
        rows = f"SELECT *, CASE WHEN abs({c}) <= 1e-17 * (abs({a}) + abs({b})) THEN 0.0 ELSE CASE WHEN {half} < 0 THEN -1 ELSE 1 END / (abs({half}) + sqrt({half} * {half} + 1)) END AS t FROM ({rows}) x"
        rows = f"SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM ({rows}) x"
        new = {a: f"{a} - t * {c}", b: f"{b} + t * {c}", c: "0.0"}
        for r in range(n):
            if r not in (p, q):
                new |= {h(r, p): f"c * {h(r, p)} - s * {h(r, q)}", h(r, q): f"s * {h(r, p)} + c * {h(r, q)}"}
            new |= {f"v{r}{p}": f"c * v{r}{p} - s * v{r}{q}", f"v{r}{q}": f"s * v{r}{p} + c * v{r}{q}"}
        rows = f"SELECT {k}, sweep, {', '.join(f'{new.get(x, x)} AS {x}' for x in (*h_all, *v_all))} FROM ({rows}) x"
    start = ", ".join([*(f"{x}::DOUBLE AS {x}" for x in h_all), *(f"{float(v[1] == v[2])}::DOUBLE AS {v}" for v in v_all)])
    return f"""{name}_j AS (SELECT {k}, 0 AS sweep, {start} FROM {source} UNION ALL SELECT {k}, sweep + 1, {', '.join((*h_all, *v_all))} FROM ({rows}) y),
{name} AS (SELECT {k}, {', '.join(f'{h(i, i)} AS l{i}' for i in range(n))}, {', '.join(v_all)} FROM {name}_j WHERE sweep = {sweeps})"""


def private_ridge(name: str, source: str, keys: Sequence[str], ridge: float) -> str:
    """CTEs that end in `name` (keys, n, beta, se): the second coefficient of ridge regression on noisy sums (keys, n, yy, t_i, s_ij) of `source`.

    Matrices that noise made indefinite are lifted by the first of 1e-6, 1e-5, .. 10 that exceeds the lowest eigenvalue's size, or else have eigenvalues of 1e-8 at least.
    """
    k = ", ".join(keys)
    least = "least(l0, l1, l2, l3)"
    lifts = " ".join(f"WHEN -{least} < 1e{e} THEN l{{i}} + 1e{e}" for e in range(-6, 2))
    s = lambda i, j: f"s_{min(i, j)}{max(i, j)}"
    inverse = lambda i, j: "(" + " + ".join(f"v{i}{m} * v{j}{m} / e{m}" for m in range(4)) + ")"
    fitted = " + ".join(f"({' + '.join(f'{s(i, j)} * b{j}' for j in range(4))} - 2 * t_{i}) * b{i}" for i in range(4))
    on = " AND ".join(f"a.{x} = m.{x}" for x in keys)
    h = ", ".join(f"{s(i, j)} + {ridge if i == j else 0.0} AS h{i}{j}" for i, j in PAIRS)
    return f"""{name}_h AS (SELECT {k}, {h} FROM {source}),
{jacobi(f'{name}_e', f'{name}_h', keys)},
{name}_l AS (SELECT *, {', '.join(f'CASE {lifts.format(i=i)} ELSE greatest(l{i}, 1e-8) END AS e{i}' for i in range(4))} FROM {name}_e),
{name}_b AS (SELECT a.*, {', '.join(' + '.join(f'{inverse(i, j)} * t_{j}' for j in range(4)) + f' AS b{i}' for i in range(4))}, {inverse(1, 1)} AS spread FROM {source} a JOIN {name}_l m ON {on}),
{name}_s AS (SELECT *, yy + {fitted} AS fit FROM {name}_b),
{name} AS (SELECT {k}, n, b1 AS beta, coalesce(nullif(sqrt(greatest(spread, 1e-12) * CASE WHEN fit > 0 AND isfinite(fit) THEN fit ELSE greatest(1e-6, abs(yy)) END / greatest(1, n - 4)), 0), 1e6) AS se FROM {name}_s)"""
