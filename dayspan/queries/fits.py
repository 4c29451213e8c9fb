"""Clustered logistic fits in SQL: any number of coefficients, one pair of common table expressions per pass.

Each pass sums over the clusters and solves the p x p system by elimination, written out as nested selects.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from dayspan.queries.tables import NORMAL_TAIL

Z = repr(NormalDist().inv_cdf(0.975))


def pair(j: int, k: int) -> str:
    return f"{min(j, k)}_{max(j, k)}"


def solved(source: str, p: int, right: Sequence[Sequence[str]], keep: Sequence[str]) -> str:
    """SELECT of ``keep`` and x<i>_<c>, the solution of G x = right for each of its columns c; ``source`` has g<j>_<k>."""
    kept, c = ", ".join(keep), range(len(right[0]))
    start = [f"g{pair(i, j)} AS m0_{i}_{j}" for i in range(p) for j in range(p)]
    start += [f"{right[i][n]} AS q0_{i}_{n}" for i in range(p) for n in c]
    sql = f"SELECT {kept}, {', '.join(start)} FROM ({source})"
    for k in range(p):
        columns = []
        for i in range(p):
            cells = [("m", j) for j in range(k + 1, p)] + [("q", n) for n in c]
            for name, j in cells:
                pivot = f"{name}{k}_{k}_{j} / m{k}_{k}_{k}"
                value = pivot if i == k else f"{name}{k}_{i}_{j} - m{k}_{i}_{k} * ({pivot})"
                columns.append(f"{value} AS {name}{k + 1}_{i}_{j}")
        sql = f"SELECT {kept}, {', '.join(columns)} FROM ({sql})"
    return f"SELECT {kept}, {', '.join(f'q{p}_{i}_{n} AS x{i}_{n}' for i in range(p) for n in c)} FROM ({sql})"


def fit_sql(xs: Sequence[str], corr: str, tag: str, passes: int = 24, rows: str = "complete") -> str:
    """CTEs that fit y on the columns ``xs`` of ``rows`` (id, date, y, ...); the last one, ``fit_<tag>``, is one row.

    It has corr, a, b<j>, v<j>_<k> (robust covariance), sx<j>, quasi, cic, clusters and n.
    """
    p = len(xs) + 1
    js, pairs = range(p), [(j, k) for j in range(p) for k in range(j, p)]
    x = [f"x{j}" for j in range(1, p)]
    lagged = ", ".join(f"lag({e}) OVER w AS p{n}" for n, e in zip(x, xs))
    parts = [f"""obs_{tag} AS MATERIALIZED (
  SELECT id, {', '.join(f'{e} AS {n}' for n, e in zip(x, xs))}, y, {lagged}, lag(y) OVER w AS py,
    (CASE WHEN lag(y) OVER w IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lead(y) OVER w IS NULL THEN 0 ELSE 1 END) AS nb
  FROM {rows} WINDOW w AS (PARTITION BY id ORDER BY date))""",
             f"p_{tag}_0 AS MATERIALIZED (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in js)}, CAST(0 AS DOUBLE) AS a)"]
    eta = " + ".join(["b0", *[f"b{j} * x{j}" for j in range(1, p)]])
    peta = " + ".join(["b0", *[f"b{j} * px{j}" for j in range(1, p)]])
    z = ", ".join(["s AS z0", "ps AS pz0", *[f"s * x{j} AS z{j}, ps * px{j} AS pz{j}" for j in range(1, p)]])
    sums = [f"sum(z{j}) AS s{j}, sum(z{j} * r) AS c{j}, sum(d * z{j} * r - coalesce(o * (z{j} * pr + pz{j} * r), 0)) AS w{j}" for j in js]
    sums += [f"sum(z{j} * z{k}) AS z{j}_{k}, sum(d * z{j} * z{k} - coalesce(o * (z{j} * pz{k} + pz{j} * z{k}), 0)) AS h{j}_{k}" for j, k in pairs]
    sums += [f"sum(x{j}) AS sx{j}" for j in range(1, p)]
    shrink = "a / (1 + (n - 1) * a)"
    if corr == "ar1":
        own = [f"w{j} AS u{j}" for j in js] + [f"h{j}_{k} AS g{j}_{k}" for j, k in pairs] + ["rr AS products", "n - 1 AS pairs"]
    else:
        own = [f"(c{j} - {shrink} * s{j} * t) / (1 - a) AS u{j}" for j in js]
        own += [f"(z{j}_{k} - {shrink} * s{j} * s{k}) / (1 - a) AS g{j}_{k}" for j, k in pairs]
        own += ["(t * t - q) / 2 AS products", "n * (n - 1) / 2 AS pairs"]
    totals = [f"sum(u{j}) AS u{j}" for j in js] + [f"sum(sx{j}) AS sx{j}" for j in range(1, p)]
    totals += [f"sum(g{j}_{k}) AS g{j}_{k}, sum(u{j} * u{k}) AS mm{j}_{k}, sum(z{j}_{k}) AS zz{j}_{k}" for j, k in pairs]
    alpha = "CAST(0 AS DOUBLE)" if corr == "independence" else "CASE WHEN pairs > 0 THEN products / (q / n * pairs) ELSE 0 END"
    for i in range(1, passes + 1):
        before = f"p_{tag}_{i - 1}"
        parts.append(f"""t_{tag}_{i} AS MATERIALIZED (
  SELECT {', '.join(totals)}, sum(products) AS products, sum(pairs) AS pairs, sum(q) AS q, sum(n) AS n, count(*) AS clusters, sum(quasi) AS quasi
  FROM (SELECT *, {', '.join(own)} FROM (
    SELECT id, any_value(a) AS a, CAST(count(*) AS DOUBLE) AS n, sum(r * r) AS q, sum(r) AS t, coalesce(sum(r * pr), 0) AS rr,
      sum(y * eta - ln(1 + exp(eta))) AS quasi, {', '.join(sums)}
    FROM (SELECT *, {z}, (y - mu) / s AS r, (py - pmu) / ps AS pr, a / (1 - a * a) AS o,
        CASE nb WHEN 0 THEN 1 WHEN 1 THEN 1 / (1 - a * a) ELSE (1 + a * a) / (1 - a * a) END AS d
      FROM (SELECT *, sqrt(mu * (1 - mu)) AS s, sqrt(pmu * (1 - pmu)) AS ps
        FROM (SELECT *, {eta} AS eta, 1 / (1 + exp(-({eta}))) AS mu, 1 / (1 + exp(-({peta}))) AS pmu FROM obs_{tag}, {before})))
    GROUP BY id)))""")
        step = solved(f"SELECT * FROM t_{tag}_{i}, {before}", p, [[f"u{j}"] for j in js], [*[f"b{j}" for j in js], "products", "pairs", "q", "n"])
        parts.append(f"p_{tag}_{i} AS MATERIALIZED (SELECT {', '.join(f'b{j} + x{j}_0 AS b{j}' for j in js)}, {alpha} AS a FROM ({step}))")
    identity = [["1.0" if i == j else "0.0" for j in js] for i in js]
    stays = [*[f"b{j}" for j in js], *[f"sx{j}" for j in range(1, p)], *[f"mm{j}_{k}" for j, k in pairs], *[f"zz{j}_{k}" for j, k in pairs]]
    bread = solved(f"SELECT * FROM t_{tag}_{passes}, p_{tag}_{passes - 1}", p, identity, [*stays, "a", "quasi", "clusters", "n"])
    sandwich = [" + ".join(f"x{j}_{m} * mm{pair(m, n)} * x{n}_{k}" for m in js for n in js) + f" AS v{j}_{k}" for j, k in pairs]
    cic = " + ".join(f"zz{pair(j, k)} * v{pair(j, k)}" for j in js for k in js)
    parts.append(f"fit_{tag} AS MATERIALIZED (SELECT '{corr}' AS corr, *, {cic} AS cic FROM (SELECT *, {', '.join(sandwich)} FROM ({bread})))")
    return ",\n".join(parts)


def best_sql(xs: Sequence[str], tag: str, rows: str = "complete", passes: int = 18) -> str:
    """CTEs of both structures; ``best_<tag>`` is the fit with the smaller QIC, with qic and qicc."""
    p = len(xs) + 1
    qic = "-2 * quasi + 2 * cic"
    return f"""{fit_sql(xs, 'exchangeable', f'e{tag}', passes, rows)},
{fit_sql(xs, 'ar1', f'a{tag}', passes, rows)},
best_{tag} AS MATERIALIZED (SELECT *, {qic} AS qic, {qic} + 2.0 * {p} * ({p} + 1) / (clusters - {p} - 1) AS qicc FROM (
  SELECT * FROM fit_e{tag} UNION ALL SELECT * FROM fit_a{tag}) ORDER BY {qic}, corr DESC LIMIT 1)"""


def numeric(label: str, at: int, test: Sequence[int] = ()) -> dict:
    return {"label": label, "class": "numeric", "at": [at], "levels": [], "test": list(test) or [at]}


def factor(label: str, at: Sequence[int], levels: Sequence[str], test: Sequence[int] = ()) -> dict:
    return {"label": label, "class": "factor", "at": list(at), "levels": list(levels), "test": list(test) or list(at)}


def product(label: str, at: Sequence[int], names: Sequence[str]) -> dict:
    return {"label": label, "class": None, "at": list(at), "levels": [], "names": list(names)}


def rows_sql(outcome: str, formula: str, predictors: str, terms: Sequence[dict], tag: str, interaction: str = "N/A") -> str:
    """SELECT of the 34 result columns of a model from ``best_<tag>``."""
    p = 1 + sum(len(t["at"]) for t in terms)
    model = f"""'{outcome} ~ {formula}' AS model_formula, '{outcome}' AS outcome, '{predictors}' AS predictors, '{interaction}' AS interaction_terms,
  clusters AS n, CAST(n AS BIGINT) AS n_obs, corr AS corr_structure, 'san.se' AS se_type, round(qic, 4) AS QIC, round(-2 * quasi + {2 * p}, 4) AS QICu,
  round(qicc, 4) AS QICC, round(cic, 4) AS CIC, round(quasi, 4) AS quasi_likelihood, CAST({p} AS BIGINT) AS num_params"""

    def estimates(j: int | None) -> str:
        if j is None:
            names = ("\"or\"", "or_ci_low", "or_ci_high", "conf_level", "beta_hat", "std_error", "wald_statistic", "wald_p_value")
            return ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names)
        b, se = f"b{j}", f"sqrt(v{j}_{j})"
        return f"""round(exp({b}), 6) AS "or", round(exp({b} - {Z} * {se}), 6) AS or_ci_low, round(exp({b} + {Z} * {se}), 6) AS or_ci_high,
  CAST(0.95 AS DOUBLE) AS conf_level, round({b}, 6) AS beta_hat, round({se}, 6) AS std_error, round({b} * {b} / v{j}_{j}, 6) AS wald_statistic,
  round({NORMAL_TAIL.format(z=f"({b} / {se})")}, 6) AS wald_p_value"""

    def tested(at: Sequence[int]) -> str:
        if not at:
            return ("NULL AS anova_statistic, CAST(NULL AS DOUBLE) AS anova_chi_sq, CAST(NULL AS BIGINT) AS anova_df, "
                    "CAST(NULL AS DOUBLE) AS anova_p_value")
        if len(at) == 1:
            (j,) = at
            chi, tail = f"b{j} * b{j} / v{j}_{j}", NORMAL_TAIL.format(z=f"(b{j} / sqrt(v{j}_{j}))")
        else:
            j, k = at
            chi = f"(v{k}_{k} * b{j} * b{j} - 2 * v{pair(j, k)} * b{j} * b{k} + v{j}_{j} * b{k} * b{k}) / (v{j}_{j} * v{k}_{k} - v{pair(j, k)} * v{pair(j, k)})"
            tail = f"exp(-({chi}) / 2)"
        return f"""'Wald statistic' AS anova_statistic, round({chi}, 6) AS anova_chi_sq, CAST({len(at)} AS BIGINT) AS anova_df, round({tail}, 6) AS anova_p_value"""

    def row(predictor: str, term: str, j: int | None, label: str = "NULL", kind: str = "NULL", number: str = "NULL", level: str = "NULL",
            level_number: str = "NULL", count: str = "NULL", test: Sequence[int] = ()) -> str:
        return f"""SELECT {model}, '{predictor}' AS predictor, '{term}' AS term, {estimates(j)}, CAST({label} AS VARCHAR) AS term_label,
  CAST({kind} AS VARCHAR) AS class, CAST({number} AS BIGINT) AS term_number, CAST({level} AS VARCHAR) AS level, CAST({level_number} AS BIGINT) AS level_number,
  CAST({count} AS BIGINT) AS n_per_level, {tested(test)} FROM best_{tag}"""

    out = [row("(Intercept)", "(Intercept)", 0)]
    for number, term in enumerate(terms, start=1):
        label = term["label"]
        shared = {"label": f"'{label}'", "number": str(number)}
        if term["class"] is None:
            out += [row(label, name, j, **shared) for j, name in zip(term["at"], term["names"])]
        elif term["class"] == "numeric":
            out.append(row(label, label, term["at"][0], kind="'numeric'", count="n", test=term["test"], **shared))
        else:
            others = " - ".join(f"sx{j}" for j in term["at"])
            for n, level in enumerate(term["levels"]):
                j = term["at"][n - 1] if n else None
                out.append(row(label, f"{label}{level}", j, kind="'factor'", level=f"'{level}'", level_number=str(n + 1),
                               count=f"sx{j}" if n else f"n - {others}", test=term["test"], **shared))
    return "\nUNION ALL ".join(out)
