"""Logistic generalized estimating equations with robust errors, for many models at once.

Liang and Zeger (1986). With mu = 1/(1+exp(-x'b)), v = mu(1-mu), z = sqrt(v) x and
r = (y-mu)/sqrt(v), a cluster of size n adds Z'R^-1 r to the score and Z'R^-1 Z to the
information H; the step is H^-1 times the score, the robust covariance H^-1 (sum u u') H^-1.

* exchangeable: R^-1 = (I - c 11')/(1-a), c = a/(1+(n-1)a); a is the mean product of
  residual pairs over phi.
* AR(1): R^-1 is tridiagonal; a is the mean product of neighbouring residuals over phi.
  Neighbours are rows next to each other in the given order (a gap counts as one step).
* independence: a = 0.

phi = sum r^2 / N. Without any pair a is 0. QIC = -2Q + 2 tr(Omega V) (Pan 2001) with
Omega the independence information at the fitted coefficients, QICu = -2Q + 2p,
CIC = tr(Omega V), QICC = QIC + 2p(p+1)/(n-p-1) with n clusters.

The rows of all models are one narrow table, a row per observation with every design
column once; a model knows a row if its columns are not null there. Models that know the
same rows share the values of the row before. The table is bucketed by cluster, so a pass
sums by (model, cluster) without a shuffle, and one exchange by model ends it; the driver
receives a few sums per model and solves a small linear system. Clusters too large for a
bucket stay in a plain table next to it, whose sums are combined before their shuffle.

Every fit starts at the independence solution, where a separated model is recognized: its
likelihood has no maximum, its steps don't shrink, and along the step hardly anything is
still misfitted (expected misfits, |y - mu| weighted by how far the step moves a row, add
up to less than a tenth of one row). A finite solution always leaves misfits on both sides.
Such a model, one whose information is singular, and one that doesn't settle are marked in
the fit report and have no estimates where none exist.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.models.spec import DesignColumn, ModelSpec, design
from dayspan.operators.ordered import known_after, known_before, ordered_scan
from dayspan.session import release, stage, stage_bucketed

EXCHANGEABLE, AR1, INDEPENDENCE = "exchangeable", "ar1", "independence"

CONVERGED, SEPARATED, SINGULAR, UNSETTLED = "converged", "separated", "singular", "not settled"

_SMALLEST_VARIANCE = 1e-12
#: Rows of a cluster above which it is summed in parts; rows of a bucket and the most buckets.
CLUSTER_ROWS, _BUCKET_ROWS, _MOST_BUCKETS = 1_000_000, 1_000_000, 100_000
#: Expected misfits along a step below which it only runs away, and the smallest eigenvalue of a usable scaled information.
_FEW_MISFITS, _SMALLEST_EIGENVALUE = 0.1, 1e-10


@dataclass
class Fit:
    """Fitted model; coefficients without any information, and those that have no finite estimate, are NaN."""

    spec: ModelSpec
    columns: list[DesignColumn]
    corr: str
    beta: np.ndarray
    covariance: np.ndarray
    alpha: float
    phi: float
    n_clusters: int
    n_obs: int
    column_sums: np.ndarray
    score_norm: float
    iterations: int
    converged: bool
    quasi_likelihood: float
    cic: float
    reason: str = UNSETTLED
    smallest_eigenvalue: float = math.nan
    largest_coefficient: float = 0.0
    moment_alpha: float = 0.0
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def num_params(self) -> int:
        return int(np.isfinite(self.beta).sum())

    @property
    def qic(self) -> float:
        return -2 * self.quasi_likelihood + 2 * self.cic

    @property
    def qicu(self) -> float:
        return -2 * self.quasi_likelihood + 2 * self.num_params

    @property
    def qicc(self) -> float:
        p, room = self.num_params, self.n_clusters - self.num_params - 1
        return self.qic + 2 * p * (p + 1) / room if room > 0 else math.nan

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    def wald(self, indexes: Sequence[int]) -> tuple[float, int]:
        """Chi-square statistic and degrees of freedom for all given coefficients being 0."""
        used = [i for i in indexes if np.isfinite(self.beta[i])]
        if not used:
            return math.nan, 0
        b = self.beta[used]
        return float(b @ np.linalg.solve(self.covariance[np.ix_(used, used)], b)), len(used)


class PreparedModels:
    """Observations that any of the models knows, written once and read by every pass."""

    def __init__(self, df: DataFrame, specs: Sequence[ModelSpec], id_col: str, order: Sequence[str] = (),
                 levels: Mapping[str, Sequence[str]] | None = None, with_neighbours: bool = True,
                 cluster_rows: int = CLUSTER_ROWS):
        self.specs = list(specs)
        self.levels = dict(levels or {})
        self.columns = [design(s, self.levels) for s in self.specs]
        self.width = max(len(c) for c in self.columns)
        self.with_neighbours = with_neighbours
        self._independent: dict[int, Fit] = {}
        values: dict[tuple, str] = {}
        self.of_model: list[list[str]] = []
        expressions = {}
        for spec, columns in zip(self.specs, self.columns):
            used = []
            for key, value in [(("outcome", spec.outcome), F.col(spec.outcome).cast("double")), *[((c.term, c.name), c.value) for c in columns[1:]]]:
                name = values.setdefault(key, f"v{len(values)}")
                expressions[name] = value
                used.append(name)
            self.of_model.append(used)
        self.names = list(expressions)
        keys = [f"_o{i}" for i in range(len(order))]
        known = reduce(lambda a, b: a | b, [F.expr(self._known(m)) for m in range(len(self.specs))])
        rows = stage(
            df.filter(F.col(id_col).isNotNull()).select(
                F.col(id_col).alias("_id"), *[F.col(o).alias(k) for o, k in zip(order, keys)], *[v.alias(n) for n, v in expressions.items()]
            ).filter(known), "rows")
        self._write(rows, keys, cluster_rows)
        release(rows)

    @property
    def x_names(self) -> list[str]:
        return [f"x{j}" for j in range(1, self.width)]

    def _known(self, m: int) -> str:
        return " AND ".join(f"{name} IS NOT NULL" for name in self.of_model[m])

    def _survey(self, rows: DataFrame) -> tuple[int, int, list[int]]:
        """(rows, rows of the largest cluster, for each model the first model that knows the same rows), in one job.

        The models that know a row are the bits of a few words. Where two models differ anywhere, the bit of one
        is set in the other's union of differences.
        """
        models, size = range(len(self.specs)), 60
        words = [" + ".join(f"if({self._known(m)}, {1 << m % size}L, 0L)" for m in models[w : w + size]) for w in range(0, len(models), size)]
        masks = rows.selectExpr("_id", *[f"{word} AS k{w}" for w, word in enumerate(words)])
        differences = [f"d{m}_{w}" for m in models for w in range(len(words))]
        unions = [
            F.expr(f"bit_or(k{w} ^ ((shiftright(k{m // size}, {m % size}) & 1) * {(1 << size) - 1}L))")
            for m in models for w in range(len(words))
        ]
        found = masks.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), *[u.alias(d) for u, d in zip(unions, differences)]).agg(
            F.sum("n").alias("n"), F.max("n").alias("largest"), *[F.bit_or(d).alias(d) for d in differences]).first()
        if not found["n"]:
            return 0, 0, list(models)
        classes = [next(i for i in models if not found[f"d{m}_{i // size}"] >> i % size & 1) for m in models]
        return found["n"], found["largest"], classes

    def _write(self, rows: DataFrame, keys: list[str], cluster_rows: int) -> None:
        n, largest, self.class_of = self._survey(rows)
        buckets = min(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // _BUCKET_ROWS)), _MOST_BUCKETS)
        self.large = None
        if largest > cluster_rows:
            large_ids = stage(rows.groupBy("_id").count().filter(F.col("count") > cluster_rows).select("_id"), "large")
            self.large = stage(self._laid_out(rows.join(large_ids, "_id", "left_semi"), keys, False), "gee")
            rows = rows.join(large_ids, "_id", "left_anti")
        self.data = stage_bucketed(self._laid_out(rows.repartition(buckets, "_id"), keys, True), "gee", "_id", buckets)
        if self.large is not None:
            release(large_ids)

    def _laid_out(self, rows: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
        """Rows with those before them, once per class of models; equal rows of factors only are kept once with their number."""
        shared = {c: list(dict.fromkeys(n for m, k in enumerate(self.class_of) if k == c for n in self.of_model[m])) for c in set(self.class_of)}
        columns = list(self.names)
        if self.with_neighbours:
            scans = {}
            for c, names in shared.items():
                known = F.expr(self._known(c))
                scans[f"_b{c}"] = known_before(F.when(known, F.struct(*names)))
                scans[f"_a{c}"] = known_after(F.when(known, F.lit(1)))
            rows = ordered_scan(rows, ["_id"], keys, scans, bounded)
            beside = {f"b{c}_{n}": F.col(f"_b{c}")[n] for c, names in shared.items() for n in names}
            beside |= {f"beside{c}": (F.col(f"_b{c}").isNotNull().cast("int") + F.col(f"_a{c}").isNotNull().cast("int")) for c in shared}
            rows = rows.withColumns(beside)
            columns += beside
        if all(name in self.levels for s in self.specs for name in s.main_effects):
            return rows.groupBy("_id", *columns).agg(F.count(F.lit(1)).cast("double").alias("w"))
        return rows.select("_id", *columns, F.lit(1.0).alias("w"))

    def release(self) -> None:
        """Delete the written rows; the fits stay."""
        release(*[t for t in (self.data, self.large) if t is not None])

    def fit(self, corr: str, models: Sequence[int] | None = None, max_passes: int = 60,
            tolerance: float = 1e-10) -> dict[int, Fit]:
        """Fit the models under one working correlation; a model leaves the passes when it has converged or can't."""
        if corr == AR1 and not self.with_neighbours:
            raise ValueError("AR(1) needs rows prepared with neighbours")
        models = list(range(len(self.specs))) if models is None else list(models)
        done = {m: f for m, f in self._at_independence(models, max_passes, tolerance).items() if m in models}
        if corr == INDEPENDENCE:
            return done
        active = [m for m in done if done[m].converged]
        done = {m: f if f.converged else replace(f, corr=corr) for m, f in done.items()}
        beta = {m: np.nan_to_num(done[m].beta) for m in active}
        alpha = {m: done[m].moment_alpha if corr == EXCHANGEABLE else 0.0 for m in active}
        before = {m: done[m].iterations for m in active}
        for passes in range(1, max_passes + 1):
            if not active:
                break
            sums = self._one_pass(corr, active, beta, alpha)
            for m in list(active):
                step, new_alpha, fit = self._solve(m, corr, beta[m], alpha[m], sums[m], before[m] + passes)
                done[m] = fit
                if not np.all(np.isfinite(step)):
                    active.remove(m)
                    continue
                if np.max(np.abs(step), initial=0.0) < tolerance and abs(new_alpha - alpha[m]) < tolerance:
                    fit.converged, fit.reason = True, CONVERGED
                    active.remove(m)
                    continue
                beta[m], alpha[m] = beta[m] + step, new_alpha
        return {m: f if f.converged else _without(f, np.arange(len(f.beta))) if f.reason == UNSETTLED else f for m, f in done.items()}

    def _at_independence(self, models: Sequence[int], max_passes: int, tolerance: float) -> dict[int, Fit]:
        """Maximum likelihood fits; a step that lowers the likelihood is halved, a separated model is recognized."""
        active = [m for m in models if m not in self._independent]
        beta = {m: np.zeros(len(self.columns[m])) for m in active}
        last: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        done: dict[int, Fit] = {}
        for passes in range(1, max_passes + 1):
            if not active:
                break
            towards = {m: step for m, (_, step, _) in last.items()}
            sums = self._one_pass(INDEPENDENCE, active, beta, dict.fromkeys(active, 0.0), towards)
            for m in list(active):
                if m not in sums:
                    active.remove(m)
                    continue
                s = sums[m]
                if m in last and s["quasi"] < last[m][2] - 1e-9 * (1 + abs(last[m][2])):
                    start, step, quasi = last[m]
                    beta[m], last[m] = start + step / 2, (start, step / 2, quasi)
                    continue
                step, _, fit = self._solve(m, INDEPENDENCE, beta[m], 0.0, s, passes)
                done[m] = fit
                size = np.max(np.abs(step), initial=0.0)
                if not np.all(np.isfinite(step)):
                    fit.reason = SINGULAR
                elif size < tolerance:
                    fit.converged, fit.reason = True, CONVERGED
                elif m in last and size >= 0.5 * np.max(np.abs(last[m][1])) and s["far"] < _FEW_MISFITS * s["reach"]:
                    fit.reason = SEPARATED
                    moved = np.abs(last[m][1])
                    done[m] = _without(fit, np.flatnonzero(moved > 1e-3 * moved.max()))
                else:
                    last[m] = (beta[m], step, s["quasi"])
                    beta[m] = beta[m] + step
                    continue
                active.remove(m)
        for m, f in done.items():
            self._independent[m] = f if f.reason in (CONVERGED, SEPARATED) else _without(f, np.arange(len(f.beta)))
        return self._independent

    def _solve(self, m: int, corr: str, beta: np.ndarray, alpha: float, s: dict, passes: int):
        p = len(beta)

        def matrix(prefix: str) -> np.ndarray:
            out = np.empty((p, p))
            for j in range(p):
                for k in range(j, p):
                    out[j, k] = out[k, j] = s[f"{prefix}_{j}_{k}"]
            return out

        information, meat, omega = matrix("h"), matrix("m"), matrix("z")
        score = np.array([s[f"u_{j}"] for j in range(p)])
        used = np.flatnonzero(np.diag(omega) > 0)
        sub = np.ix_(used, used)
        step = np.zeros(p)
        covariance = np.full((p, p), np.nan)
        cic = math.nan
        # Scaled to a unit diagonal, so that the units of the columns don't matter.
        scale = np.sqrt(np.abs(np.diag(information[sub])))
        with np.errstate(all="ignore"):
            scaled = information[sub] / np.outer(scale, scale)
        usable = bool(np.all(np.isfinite(scaled)))
        smallest = float(np.linalg.eigvalsh(scaled).min(initial=1.0)) if usable else math.nan
        if usable and smallest > _SMALLEST_EIGENVALUE:
            bread = np.linalg.inv(scaled) / np.outer(scale, scale)
            step[used] = bread @ score[used]
            covariance[sub] = bread @ meat[sub] @ bread
            cic = float(np.trace(omega[sub] @ covariance[sub]))
        else:
            step[:] = np.nan
        n_obs, squares = s["n"], s["q"]
        phi = squares / n_obs

        def moment(lowest: float) -> float:
            if not (s["pairs"] > 0 and phi > 0):
                return 0.0
            return min(max(s["products"] / (phi * s["pairs"]), lowest + 1e-6), 1 - 1e-6)

        lowest = -1.0 if corr == AR1 else -1 / max(s["largest"] - 1, 1)
        shown = np.where(np.diag(omega) > 0, beta, np.nan)
        fit = Fit(
            self.specs[m], self.columns[m], corr, shown, covariance, alpha, phi, int(s["clusters"]),
            int(round(n_obs)), np.array([n_obs] + [s[f"x_{j}"] for j in range(1, p)]),
            float(np.max(np.abs(score))), passes, False, s["quasi"], cic, smallest_eigenvalue=smallest,
            largest_coefficient=float(np.max(np.abs(beta), initial=0.0)), moment_alpha=moment(lowest), levels=self.levels,
        )
        return step, 0.0 if corr == INDEPENDENCE else fit.moment_alpha, fit

    def _observations(self, active: list[int], corr: str) -> str:
        """SELECT of the observations of the active models: m, _id, w, y, x1, x2, ... and, with b_ before them, the row before."""
        before = corr == AR1
        entries = []
        for m in active:
            names, c = self.of_model[m], self.class_of[m]
            xs = names[1:] + ["0D"] * (self.width - len(names))
            fields = [f"'m', {m}", f"'y', {names[0]}", *[f"'{x}', {v}" for x, v in zip(self.x_names, xs)]]
            if before:
                # Without a row before, the padding is unknown too.
                behind = [f"b{c}_{v}" if v != "0D" else f"if(b{c}_{names[0]} IS NULL, NULL, 0D)" for v in [names[0], *xs]]
                fields += [f"'b_{x}', {v}" for x, v in zip(["y", *self.x_names], behind)] + [f"'neighbours', beside{c}"]
            entries.append(f"if({self._known(m)}, named_struct({', '.join(fields)}), NULL)")
        return f"SELECT * FROM (SELECT _id, w, inline(array({', '.join(entries)})) FROM {{source}}) WHERE m IS NOT NULL"

    def pass_sql(self, corr: str, active: list[int], beta: dict, alpha: dict, towards: dict | None = None) -> str:
        """One pass as a query of the written rows ({data}, and {large} for clusters that are summed in parts)."""
        p = self.width
        pairs = [(j, k) for j in range(p) for k in range(j, p)]
        listed = range(max(active) + 1)

        # Coefficients are array literals indexed by model, so the generated code is the same in every pass.
        def literal(values: Sequence[float]) -> str:
            return f"get(array({', '.join(f'double({float(v)!r})' for v in values)}), m)"

        coefficients = [
            literal([beta[m][j] if m in beta and j < len(beta[m]) else 0.0 for m in listed]) + f" AS c{j}"
            for j in range(p)
        ]
        a = literal([alpha.get(m, 0.0) for m in listed]) + " AS a"
        steps = [
            literal([towards[m][j] if m in towards and j < len(towards[m]) else 0.0 for m in listed]) + f" AS d{j}" for j in range(p)
        ] if towards is not None else []
        rows = f"SELECT *, {', '.join([*coefficients, *steps, a])} FROM ({self._observations(active, corr)})"

        def extend(inner: str, columns: Sequence[str]) -> str:
            return f"SELECT *, {', '.join(columns)} FROM ({inner})"

        # z and r of a row; with the prefix b_ those of the row before it.
        sides = ["", "b_"] if corr == AR1 else [""]
        eta = {t: " + ".join(["c0", *[f"c{j} * {t}x{j}" for j in range(1, p)]]) for t in sides}
        if towards is not None:
            eta["t"] = " + ".join(["d0", *[f"d{j} * x{j}" for j in range(1, p)]])
        rows = extend(rows, [f"{e} AS {t}eta" for t, e in eta.items()])
        rows = extend(rows, [f"1 / (1 + exp(-{t}eta)) AS {t}mu" for t in sides])
        # greatest() skips nulls, so a first row (nothing before it) is kept null by hand.
        floor = {t: f"greatest({t}mu * (1 - {t}mu), {_SMALLEST_VARIANCE}D)" for t in sides}
        rows = extend(rows, [f"if({t}mu IS NULL, NULL, sqrt({floor[t]})) AS {t}z0" for t in sides])
        rows = extend(
            rows,
            [f"({t}y - {t}mu) / {t}z0 AS {t}r" for t in sides]
            + [f"{t}z0 * {t}x{j} AS {t}z{j}" for t in sides for j in range(1, p)],
        )
        cluster = {
            "n": "sum(w)",
            "q": "sum(w * r * r)",
            "quasi": "sum(w * (y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta)))))",
            **{f"x_{j}": f"sum(w * x{j})" for j in range(1, p)},
            **{f"z_{j}_{k}": f"sum(w * z{j} * z{k})" for j, k in pairs},
        }
        if towards is not None:
            cluster |= {"far": "sum(w * abs(y - mu) * abs(teta))", "reach": "max(abs(teta))"}
        if corr == AR1:
            # Diagonal of R^-1 by number of neighbours: 1 alone, 1/(1-a^2) at an end, (1+a^2)/(1-a^2) inside.
            rows = extend(
                rows,
                ["a / (1 - a * a) AS beside",
                 "CASE neighbours WHEN 0 THEN 1D WHEN 1 THEN 1 / (1 - a * a) ELSE (1 + a * a) / (1 - a * a) END AS own"],
            )

            def form(left: str, right: str) -> str:
                cross = f"{left} * b_{right} + b_{left} * {right}"
                return f"sum(w * (own * {left} * {right} - coalesce(beside * ({cross}), 0D)))"

            cluster |= {f"u_{j}": form(f"z{j}", "r") for j in range(p)}
            cluster |= {f"h_{j}_{k}": form(f"z{j}", f"z{k}") for j, k in pairs}
            cluster["products"] = "coalesce(sum(w * r * b_r), 0D)"
            derived = {"pairs": "n - 1"}
        else:
            cluster |= {f"s_{j}": f"sum(w * z{j})" for j in range(p)}
            cluster |= {f"v_{j}": f"sum(w * z{j} * r)" for j in range(p)}
            cluster |= {"t": "sum(w * r)", "a": "first(a)"}
            c = "a / (1 + (n - 1) * a)"
            derived = {
                **{f"u_{j}": f"(v_{j} - {c} * s_{j} * t) / (1 - a)" for j in range(p)},
                **{f"h_{j}_{k}": f"(z_{j}_{k} - {c} * s_{j} * s_{k}) / (1 - a)" for j, k in pairs},
                "products": "(t * t - q) / 2",
                "pairs": "n * (n - 1) / 2",
            }

        def named(columns: Mapping[str, str]) -> list[str]:
            return [f"{e} AS {n}" for n, e in columns.items()]

        sums = f"SELECT m, _id, {', '.join(named(cluster))} FROM ({rows}) GROUP BY m, _id"
        tables = ["{data}"] if self.large is None else ["{data}", "{large}"]
        sums = extend(" UNION ALL ".join(sums.replace("{source}", table) for table in tables), named(derived))
        plain = ["n", "q", "quasi", "products", "pairs", *[f"x_{j}" for j in range(1, p)],
                 *[f"u_{j}" for j in range(p)], *[f"{b}_{j}_{k}" for b in "hz" for j, k in pairs]]
        total = {
            **{name: f"sum({name})" for name in plain},
            **{f"m_{j}_{k}": f"sum(u_{j} * u_{k})" for j, k in pairs},
            "largest": "max(n)",
            "clusters": "count(1)",
        }
        if towards is not None:
            total |= {"far": "sum(far)", "reach": "max(reach)"}
        return f"SELECT m, {', '.join(named(total))} FROM ({sums}) GROUP BY m"

    def pass_frame(self, *args) -> DataFrame:
        tables = {"data": self.data} | ({"large": self.large} if self.large is not None else {})
        return self.data.sparkSession.sql(self.pass_sql(*args), **tables)

    def _one_pass(self, *args) -> dict[int, dict]:
        """Sums of all active models at their current coefficients."""
        return {row["m"]: row.asDict() for row in self.pass_frame(*args).collect()}


def _without(fit: Fit, at: np.ndarray) -> Fit:
    """The fit without estimates at some coefficients, and without statistics that depend on all of them."""
    beta, covariance = fit.beta.copy(), fit.covariance.copy()
    beta[at] = math.nan
    covariance[at, :] = covariance[:, at] = math.nan
    return replace(fit, beta=beta, covariance=covariance, quasi_likelihood=math.nan, cic=math.nan)


def gee_fit(df: DataFrame, spec: ModelSpec, id_col: str, order: Sequence[str] = (), corr: str = EXCHANGEABLE,
            levels: Mapping[str, Sequence[str]] | None = None, cluster_rows: int = CLUSTER_ROWS) -> Fit:
    """Fit one model under one working correlation."""
    prepared = PreparedModels(df, [spec], id_col, order, levels, corr == AR1, cluster_rows)
    fits = prepared.fit(corr)
    prepared.release()
    if not fits:
        raise ValueError("no complete observations")
    return fits[0]


def gee_select(df: DataFrame, specs: Sequence[ModelSpec], id_col: str, order: Sequence[str],
               levels: Mapping[str, Sequence[str]] | None = None, cluster_rows: int = CLUSTER_ROWS) -> list[Fit]:
    """Fit every model as exchangeable and AR(1) and keep the one with the smaller QIC (exchangeable on a tie).

    A model whose odds ratios overflow, or that settles under neither structure, takes its independence fit, and
    so does one without a solution, which carries the reason.
    """
    prepared = PreparedModels(df, specs, id_col, order, levels, True, cluster_rows)
    independent = prepared.fit(INDEPENDENCE)
    # The two structures only share the data, so their jobs are submitted side by side.
    with ThreadPoolExecutor(2) as pool:
        exchangeable, ar1 = pool.map(prepared.fit, (EXCHANGEABLE, AR1))
    prepared.release()
    chosen: dict[int, Fit] = {}
    for m, plain in independent.items():
        settled = [f for f in (exchangeable[m], ar1[m]) if f.converged and math.isfinite(f.qic)]
        best = min(settled, key=lambda f: f.qic) if settled else plain
        overflows = np.any(np.isinf(np.exp(np.nan_to_num(best.beta))))
        chosen[m] = plain if overflows else best
    return [chosen[m] for m in sorted(chosen)]
