"""Gaussian multilevel VAR by accelerated EM on per-person moments (M3, M4, M5, M8).

Outcomes ``o``, each with fixed columns ``X_o`` and random columns ``Z_o``
(subsets of the moment terms), random effects ``b ~ N(0, Psi)`` stacked
over the outcomes (correlated), residuals ``N(0, Sigma)`` across outcomes
at the same occasion.  Maximum likelihood by EM:

* E-step per person (``A = Psi^-1 + [S_oq Z_o'Z_q]``, ``r_o = sum_q S_oq
  (Z_o'Y_q - Z_o'X_q beta_q)``, ``b = A^-1 r``, ``V = A^-1``);
* M-step from sums over persons: ``Psi = mean(V + b b')``, ``beta`` from
  the GLS equations with offset ``Z b``, ``Sigma`` from the expected
  residual cross-products.  A prior adds to these sums, and what is climbed
  is the log-posterior.

Each pass is one ``mapInPandas`` over the moments table (one row per
person) with stacked linear algebra on pieces of bounded size; a task adds up
its pieces, the tasks' sums are summed by Spark and one vector reaches the
driver.  A pass can carry several fits
at once (``fits``), each leaving out the persons of a fold.

EM steps are extrapolated (squared iterative steps on Cholesky factors).
A step that lowers the marginal log-likelihood is taken back, so the
path never falls.  The fit ends when an EM step changes no parameter by
more than ``tol`` of its size and the log-likelihood by less than ``tol``
relative; ``converged`` tells whether it did within ``max_iter`` passes,
and the log-likelihood is that of the parameters returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.models.moments import ONE, as_arrays, pieces, pooled_ols, stacked, task_sums
from panelflow.operators.ranks import null_safe
from panelflow.session import discard, write_through

LOG2PI = float(np.log(2 * np.pi))


@dataclass
class Shape:
    """Column numbers of a model's terms, and how its sums lie in one vector."""

    terms: list[str]
    ys: list[str]
    fixed: dict[str, list[str]]
    random: dict[str, list[str]]

    def __post_init__(self):
        at = self.terms.index
        self.k = len(self.ys)
        self.fx = [[at(c) for c in self.fixed[y]] for y in self.ys]
        self.rz = [[at(c) for c in self.random[y]] for y in self.ys]
        self.xo = np.concatenate([[0], np.cumsum([len(f) for f in self.fx])]).astype(int)
        self.zo = np.concatenate([[0], np.cumsum([len(r) for r in self.rz])]).astype(int)
        self.p, self.q = int(self.xo[-1]), int(self.zo[-1])
        # columns of the stacked X and Z among (term, outcome) pairs
        self.xcols, self.zcols = np.concatenate(self.fx), np.concatenate(self.rz)
        self.xy = np.repeat(np.arange(self.k), np.diff(self.xo))
        self.zy = np.repeat(np.arange(self.k), np.diff(self.zo))
        self.sizes = [self.q * self.q, self.k * self.k, self.p * self.k, self.p * self.p, 3]
        self.width = sum(self.sizes)
        self.held = (len(self.terms) + self.k + self.p + self.q) ** 2   # numbers a person's matrices take together, at most

    def split(self, v: np.ndarray):
        """Named blocks of a summed vector."""
        parts = np.split(v, np.cumsum(self.sizes)[:-1])
        return (parts[0].reshape(self.q, self.q), parts[1].reshape(self.k, self.k),
                parts[2].reshape(self.p, self.k), parts[3].reshape(self.p, self.p), parts[4])


@dataclass
class Prior:
    """Normal prior of the fixed effects (their order is the stacked one) and inverse-Wishart prior of Psi.

    ``precision`` 0 is a flat prior of that effect; ``df`` and ``scale`` of
    the inverse Wishart, whose density falls with
    ``|Psi|^-(df + q + 1)/2 exp(-tr(scale Psi^-1) / 2)``.
    """

    mean: np.ndarray
    precision: np.ndarray
    df: float
    scale: np.ndarray

    def log(self, beta: np.ndarray, psi: np.ndarray) -> float:
        """Log density, up to a constant."""
        away = beta - self.mean
        q = len(psi)
        return float(-0.5 * (self.precision @ (away * away)) - 0.5 * (self.df + q + 1) * np.linalg.slogdet(psi)[1]
                     - 0.5 * np.trace(np.linalg.solve(psi, self.scale)))


def prior(s: Shape, *, slope_sd: float = 1.0, intercept_sd: float = 2.5, psi_sd: float = 0.3, df: float | None = None,
          mean: Mapping[str, float] | None = None) -> Prior:
    """Weakly informative prior for standardised outcomes: normal around ``mean`` (0 where a term is not named).

    ``psi_sd``: the standard deviation of random effects at the prior's mode
    of Psi; ``df`` (q + 1 if not given) is its weight in persons.
    """
    names = [t for y in s.ys for t in s.fixed[y]]
    sd = np.array([intercept_sd if t == ONE else slope_sd for t in names])
    df = s.q + 1 if df is None else df
    return Prior(np.array([(mean or {}).get(t, 0.0) for t in names]), 1.0 / sd**2, df, np.eye(s.q) * psi_sd**2 * (df + s.q + 1))


def e_step(s: Shape, ww, wy, yy, n, beta, sigma, psi) -> np.ndarray:
    """Expected sums of each person (persons, width); the last three are log-likelihood, rows and 1."""
    s_inv, psi_inv = np.linalg.inv(sigma), np.linalg.inv(psi)
    sz, sx = s_inv[np.ix_(s.zy, s.zy)], s_inv[np.ix_(s.zy, s.xy)]
    zz, zx = ww[:, s.zcols][:, :, s.zcols], ww[:, s.zcols][:, :, s.xcols]
    xx = ww[:, s.xcols][:, :, s.xcols]
    zy, xy = wy[:, s.zcols], wy[:, s.xcols]          # (persons, columns, outcomes)
    a = psi_inv + sz * zz
    r = np.einsum("nzk,zk->nz", zy, s_inv[s.zy]) - np.einsum("nzx,x->nz", sx * zx, beta)
    v = np.linalg.inv(a)
    b = np.einsum("nij,nj->ni", v, r)
    logdet = np.linalg.slogdet(a)[1] + np.linalg.slogdet(psi)[1] + n * np.linalg.slogdet(sigma)[1]
    pick_x = np.zeros((s.p, s.k))
    pick_x[np.arange(s.p), s.xy] = 1.0
    pick_z = np.zeros((s.q, s.k))
    pick_z[np.arange(s.q), s.zy] = 1.0
    bx = pick_x * beta[:, None]                       # (x columns, outcome)
    yxb = np.einsum("nxk,xo->nok", xy, bx)            # beta_o' X_o'Y_k
    eps = yy - yxb - np.swapaxes(yxb, 1, 2) + np.einsum("xo,nxw,wk->nok", bx, xx, bx)
    quad = np.einsum("ok,nok->n", s_inv, eps)
    ll = -0.5 * (s.k * n * LOG2PI + logdet + quad - np.einsum("ni,ni->n", r, b))
    vbb = v + b[:, :, None] * b[:, None, :]
    zb = pick_z * b[:, :, None]                       # (persons, z columns, outcome)
    yzb = np.einsum("nzk,nzo->nok", zy, zb)
    czz = np.einsum("zo,nzw,wk->nok", pick_z, zz * vbb, pick_z)
    c = yy - yzb - np.swapaxes(yzb, 1, 2) + czz       # residual cross-products before the fixed part
    g = xy - np.einsum("nxz,nzk->nxk", np.swapaxes(zx, 1, 2), zb)
    flat = [x.reshape(len(n), x.shape[1] * x.shape[2]) for x in (vbb, c, g, xx)]
    return np.concatenate([*flat, np.stack([ll, n, np.ones(len(n))], 1)], axis=1)


def m_step(s: Shape, total: np.ndarray, sigma: np.ndarray, floor: float, prior: Prior | None = None):
    """(beta, Sigma, Psi) from the summed expectations; with a prior those of the greatest posterior density."""
    vbb, c, g, h, (_, n, persons) = s.split(total)
    s_inv = np.linalg.inv(sigma)
    lhs = s_inv[np.ix_(s.xy, s.xy)] * h
    rhs = np.einsum("xk,xk->x", g, s_inv[s.xy])
    if prior is not None:
        lhs, rhs = lhs + np.diag(prior.precision), rhs + prior.precision * prior.mean
        vbb, persons = vbb + prior.scale, persons + prior.df + s.q + 1
    beta = np.linalg.solve(lhs, rhs)
    pick = np.zeros((s.p, s.k))
    pick[np.arange(s.p), s.xy] = 1.0
    bx = pick * beta[:, None]
    bg = bx.T @ g
    new = (c - bg - bg.T + bx.T @ h @ bx) / n
    psi = vbb / persons
    return beta, _safe(new, floor), _safe(psi, floor)


def _safe(a: np.ndarray, floor: float) -> np.ndarray:
    """Symmetric with eigenvalues of at least ``floor``."""
    w, q = np.linalg.eigh((a + a.T) / 2)
    return (q * np.maximum(w, floor)) @ q.T


def _pack(beta, sigma, psi) -> np.ndarray:
    out = [beta]
    for m in (sigma, psi):
        low = np.linalg.cholesky(m)
        low[np.diag_indices_from(low)] = np.log(np.diag(low))
        out.append(low[np.tril_indices_from(low)])
    return np.concatenate(out)


def _unpack(s: Shape, v: np.ndarray):
    beta, at, mats = v[:s.p], s.p, []
    for size in (s.k, s.q):
        low = np.zeros((size, size))
        m = size * (size + 1) // 2
        low[np.tril_indices(size)] = v[at:at + m]
        low[np.diag_indices(size)] = np.exp(np.clip(np.diag(low), -30, 30))
        mats.append(low @ low.T)
        at += m
    return beta, mats[0], mats[1]


def person_sums(s: Shape, moments: DataFrame, params: list, fold: str | None = None,
                inside: bool = False) -> list[np.ndarray]:
    """Summed expectations for each parameter set in one pass.

    With ``fold`` (a column of the moments), set number j leaves out the
    persons of fold j, or takes only those (``inside``).
    """
    moments, names = as_arrays(moments)

    def run(batches):
        def sums():
            for pdf in pieces(batches, s.held):
                arrays, n = stacked(pdf, names, s.terms, s.ys), pdf["n"].to_numpy(float)
                out = []
                for j, (beta, sigma, psi) in enumerate(params):
                    rows = np.ones(len(pdf), bool) if fold is None else (pdf[fold].to_numpy() == j) == inside
                    got = e_step(s, *[a[rows] for a in arrays], n[rows], beta, sigma, psi)
                    out.append(got.sum(axis=0))
                yield np.concatenate(out)

        yield from task_sums(sums())

    sums = moments.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(s.width * len(params))
    for r in sums:
        flat[r.i] = r.x
    return np.split(flat, len(params))


class _Fit:
    """One fit's place in its extrapolation cycle: it is shown sums and names the parameters to try next."""

    def __init__(self, s: Shape, start, tol: float, floor: float, prior: Prior | None = None):
        self.s, self.tol, self.floor, self.prior = s, tol, floor, prior
        self.ask, self.best = start, None
        self.loglik = self.ll = -np.inf     # ll: what is climbed, the log-posterior where there is a prior
        self.path, self.done, self.points, self.back = [], False, [], None

    def show(self, total: np.ndarray) -> None:
        loglik = float(self.s.split(total)[4][0])
        ll = loglik if self.prior is None else loglik + self.prior.log(self.ask[0], self.ask[2])
        if self.back is not None and not ll >= self.ll - 1e-9 * abs(self.ll):
            self.ask, self.back, self.points = self.back, None, []   # the leap went too far
            return
        self.back = None
        step = m_step(self.s, total, self.ask[1], self.floor, self.prior)
        here, there = _pack(*self.ask), _pack(*step)
        change = max(float(np.max(np.abs(b - a) / (1 + np.abs(a)))) for a, b in zip(self.ask, step, strict=True))
        settled = abs(ll - self.ll) <= self.tol * (1 + abs(ll))
        self.best, self.total, self.ll, self.loglik = self.ask, total, ll, loglik
        self.path.append(ll)
        if change <= self.tol and settled:
            self.done = True
            return
        self.points.append(here)
        self.ask = step
        if len(self.points) == 2:
            r = self.points[1] - self.points[0]
            v = there - self.points[1] - r
            size = np.linalg.norm(v)
            if size > 1e-14:
                leap = max(1.0, np.linalg.norm(r) / size)
                self.back = step
                self.ask = _unpack(self.s, self.points[0] + 2 * leap * r + leap * leap * v)
            self.points = []


def fit_many(moments: DataFrame, s: Shape, *, fits: int = 1, fold: str | None = None,
             max_iter: int = 1000, tol: float = 1e-6, prior: Prior | None = None) -> list[dict]:
    """Fit ``fits`` copies of a model, copy j without the persons of fold j, in the same passes."""
    beta, resid = [], np.zeros((s.k, s.k))
    for o, y in enumerate(s.ys):
        ols = pooled_ols(moments, [c for c in s.fixed[y] if c != ONE], [y], intercept=ONE in s.fixed[y], with_se=False)
        place = {t: i for i, t in enumerate(ols["terms"])}
        beta += [float(ols["B"][place[c], 0]) for c in s.fixed[y]]
        resid[o, o] = max(float(ols["resid_cov"][0, 0]), 1e-6)
    floor = 1e-9 * float(np.mean(np.diag(resid)))
    start = (np.array(beta), resid, np.eye(s.q) * 0.1 * float(np.mean(np.diag(resid))))
    all_ = [_Fit(s, start, tol, floor, prior) for _ in range(fits)]
    passes = 0
    while passes < max_iter and not all(f.done for f in all_):
        passes += 1
        for f, total in zip(all_, person_sums(s, moments, [f.ask for f in all_], fold), strict=True):
            if not f.done:
                f.show(total)
    return [_result(s, f, passes) for f in all_]


def _result(s: Shape, f: _Fit, passes: int) -> dict:
    beta, sigma, psi = f.best
    h, (ll, n, persons) = s.split(f.total)[3], s.split(f.total)[4]
    by = {y: dict(zip(s.fixed[y], map(float, beta[s.xo[o]:s.xo[o + 1]]), strict=True)) for o, y in enumerate(s.ys)}
    return {"beta": by, "sigma": sigma, "psi": psi, "loglik": f.loglik, "logpost": f.ll, "prior": f.prior, "path": f.path, "passes": passes,
            "converged": f.done, "n": int(n), "persons": int(persons), "params": (beta, sigma, psi), "shape": s, "xx": h}


def fixed_covariance(moments: DataFrame, fit: dict) -> np.ndarray:
    """Covariance of the fixed effects: inverse of the marginal information, summed over persons in one pass."""
    s, (_, sigma, psi) = fit["shape"], fit["params"]
    moments, names = as_arrays(moments)

    def run(batches):
        s_inv, psi_inv = np.linalg.inv(sigma), np.linalg.inv(psi)

        def sums():
            for pdf in pieces(batches, s.held):
                ww, _, _ = stacked(pdf, names, s.terms, s.ys)
                zz, zx = ww[:, s.zcols][:, :, s.zcols], ww[:, s.zcols][:, :, s.xcols]
                a = psi_inv + s_inv[np.ix_(s.zy, s.zy)] * zz
                b = s_inv[np.ix_(s.zy, s.xy)] * zx
                info = s_inv[np.ix_(s.xy, s.xy)] * ww[:, s.xcols][:, :, s.xcols] - np.swapaxes(b, 1, 2) @ np.linalg.solve(a, b)
                yield info.sum(axis=0).ravel()

        yield from task_sums(sums())

    info = np.zeros(s.p * s.p)
    known = 0.0 if fit.get("prior") is None else np.diag(fit["prior"].precision)
    for r in moments.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        info[r.i] = r.x
    return np.linalg.inv(info.reshape(s.p, s.p) + known)


def shape(terms: Sequence[str], outcomes: Sequence[str], fixed: Mapping[str, Sequence[str]],
          random: Mapping[str, Sequence[str]]) -> Shape:
    return Shape([ONE] + [t for t in terms if t != ONE], list(outcomes),
                 {y: list(fixed[y]) for y in outcomes}, {y: list(random[y]) for y in outcomes})


def fit_mixed_var(moments: DataFrame, terms: Sequence[str], outcomes: Sequence[str],
                  fixed: Mapping[str, Sequence[str]], random: Mapping[str, Sequence[str]], *,
                  max_iter: int = 1000, tol: float = 1e-6, prior: Prior | None = None) -> dict:
    """Fit one model by maximum likelihood, or with a ``prior`` (see :func:`prior`) by maximum posterior density.

    ``terms`` lists the moment terms; ``fixed[y]`` /
    ``random[y]`` the columns of each outcome.

    Returns beta and its covariance, Sigma, Psi, the log-likelihood of these
    parameters, the path of what is climbed (log-likelihood or log-posterior,
    which never falls), passes, and whether the fit converged.
    """
    mom = write_through(moments)   # read in every pass
    s = shape(terms, outcomes, fixed, random)
    fit = fit_many(mom, s, max_iter=max_iter, tol=tol, prior=prior)[0]
    fit["cov"] = fixed_covariance(mom, fit)
    discard(mom)
    return fit


def result_table(spark, fit: dict) -> DataFrame:
    """(part, outcome, term, value, std_error): the fit as rows; std_error of fixed effects only."""
    s, se = fit["shape"], np.sqrt(np.maximum(np.diag(fit["cov"]), 0.0))
    rows, at = [], 0
    for y in s.ys:
        for t in s.fixed[y]:
            rows.append(("fixed", y, t, fit["beta"][y][t], float(se[at])))
            at += 1
    for i, u in enumerate(s.ys):
        rows += [("sigma", u, v, float(fit["sigma"][i, j]), None) for j, v in enumerate(s.ys) if j >= i]
    names = [(y, t) for y in s.ys for t in s.random[y]]
    rows += [("psi", f"{u}:{a}", f"{v}:{b}", float(fit["psi"][i, j]), None)
             for i, (u, a) in enumerate(names) for j, (v, b) in enumerate(names) if j >= i]
    shown = ("loglik", "converged", "n", "persons") if fit["prior"] is None else ("loglik", "logpost", "converged", "n", "persons")
    rows += [("fit", "", name, float(fit[name]), None) for name in shown]
    return spark.createDataFrame(rows, "part string, outcome string, term string, value double, std_error double")


def person_loglik(s: Shape, moments: DataFrame, key: str, params: list, fold: str) -> DataFrame:
    """(key, loglik): each person's marginal log-likelihood under the fit that left its fold out."""
    kind = moments.schema[key].dataType.simpleString()
    moments, names = as_arrays(moments)

    def run(batches):
        for pdf in pieces(batches, s.held):
            arrays, n = stacked(pdf, names, s.terms, s.ys), pdf["n"].to_numpy(float)
            out = np.zeros(len(pdf))
            for j, (beta, sigma, psi) in enumerate(params):
                rows = pdf[fold].to_numpy() == j
                if rows.any():
                    out[rows] = e_step(s, *[a[rows] for a in arrays], n[rows], beta, sigma, psi)[:, -3]
            yield pd.DataFrame({key: pdf[key], "loglik": out})

    return moments.mapInPandas(run, f"{key} {kind}, loglik double")


def compare_models(moments: DataFrame, key: str, models: Mapping[str, Shape], *, folds: int = 5,
                   max_iter: int = 1000, tol: float = 1e-5) -> DataFrame:
    """Leave-persons-out comparison (M4), best first.

    Every model is fitted ``folds`` times on the same moments, each time
    without the persons of one fold (a hash of the id), all in the same
    passes.  elpd is the sum of the left-out persons' log-likelihoods;
    elpd_diff and its standard error are to the best model, over persons.
    """
    mom = write_through(moments.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")))
    every = None
    for name, s in models.items():
        fits = fit_many(mom, s, fits=folds, fold="_fold", max_iter=max_iter, tol=tol)
        ll = person_loglik(s, mom, key, [f["params"] for f in fits], "_fold").select(
            key, F.lit(name).alias("model"), "loglik", F.lit(all(f["converged"] for f in fits)).alias("converged"))
        every = ll if every is None else every.unionByName(ll)
    every = write_through(every)
    total = every.groupBy("model").agg(F.sum("loglik").alias("elpd"), F.first("converged").alias("converged"))
    top = total.agg(F.max_by("model", "elpd").alias("_best"))
    best = every.join(F.broadcast(top), F.col("model") == F.col("_best")).select(key, F.col("loglik").alias("_top"))
    diff = null_safe(every, best, [key]).withColumn("_d", F.col("loglik") - F.col("_top"))
    diff = diff.groupBy("model").agg(F.sum("_d").alias("elpd_diff"), F.count("*").alias("persons"),
                                     (F.stddev_samp("_d") * F.sqrt(F.count("*"))).alias("se_diff"))
    return total.join(diff, "model").select("model", "elpd", "elpd_diff", "se_diff", "persons", "converged").orderBy(
        F.desc("elpd"), "model")


# --- leaving out one row -------------------------------------------------------------
def person_posteriors(s: Shape, moments: DataFrame, key: str, params, prefix: str) -> DataFrame:
    """(key, <prefix>_v, <prefix>_b): each person's random effects given all of its rows, covariance and mean."""
    beta, sigma, psi = params
    kind = moments.schema[key].dataType.simpleString()
    moments, names = as_arrays(moments)

    def run(batches):
        s_inv, psi_inv = np.linalg.inv(sigma), np.linalg.inv(psi)
        for pdf in pieces(batches, s.held):
            ww, wy, _ = stacked(pdf, names, s.terms, s.ys)
            zz, zx = ww[:, s.zcols][:, :, s.zcols], ww[:, s.zcols][:, :, s.xcols]
            v = np.linalg.inv(psi_inv + s_inv[np.ix_(s.zy, s.zy)] * zz)
            r = np.einsum("nzk,zk->nz", wy[:, s.zcols], s_inv[s.zy]) - np.einsum("nzx,x->nz", s_inv[np.ix_(s.zy, s.xy)] * zx, beta)
            b = np.einsum("nij,nj->ni", v, r)
            yield pd.DataFrame({key: pdf[key], f"{prefix}_v": list(v.reshape(len(pdf), -1)), f"{prefix}_b": list(b)})

    return moments.mapInPandas(run, f"`{key}` {kind}, {prefix}_v array<double>, {prefix}_b array<double>")


def row_densities(s: Shape, w: np.ndarray, y: np.ndarray, v: np.ndarray, b: np.ndarray, params) -> np.ndarray:
    """log p(row | the person's other rows) of each row at given parameters, exactly.

    ``w``: rows x terms, ``y``: rows x outcomes, ``v``/``b``: the person's
    posterior given all rows, this one too.  Taking the row's own information
    away is a downdate of rank k (the outcomes); with ``M = Z V Z'`` and
    ``e = y - X beta - Z b`` the density is that of ``e`` under
    ``(Sigma - M)``, corrected by ``|Sigma - M| / |Sigma|``.
    """
    beta, sigma, _ = params
    n, k = y.shape
    z = np.zeros((n, k, s.q))
    z[:, s.zy, np.arange(s.q)] = w[:, s.zcols]
    e = y.copy()
    for o in range(k):
        own = slice(s.xo[o], s.xo[o + 1])
        e[:, o] -= w[:, s.xcols[own]] @ beta[own]
    e -= np.einsum("nkq,nq->nk", z, b)
    left = sigma - z @ v @ np.swapaxes(z, 1, 2)
    quad = np.einsum("nk,nk->n", e, np.linalg.solve(left, e[:, :, None])[:, :, 0])
    logdet = 2 * np.linalg.slogdet(sigma)[1] - np.linalg.slogdet(left)[1]
    return -0.5 * (k * LOG2PI + logdet + quad)


def leave_row_out(rows: DataFrame, moments: DataFrame, key: str, row_id: str, fits: Mapping[str, dict]) -> DataFrame:
    """(key, row_id, <model>...): each row's log density given its person's other rows, a column for each fit (M4).

    ``rows`` are those that ``moments`` sums up (complete in all terms and
    outcomes).  Parameters stay at the fits; the random effects don't see the
    row.  One join of the rows with one row per person, no refits; rows
    without an id are one person.
    """
    shapes = {m: f["shape"] for m, f in fits.items()}
    params = {m: f["params"] for m, f in fits.items()}
    need = sorted({c for s in shapes.values() for c in [*s.terms, *s.ys] if c != ONE})
    person = F.struct(F.col(key).alias("id"))
    d = rows.dropna(how="any", subset=need).select(person.alias("_k"), key, row_id, *[F.col(c).cast("double").alias(c) for c in need])
    for i, m in enumerate(fits):
        post = person_posteriors(shapes[m], moments, key, params[m], f"_m{i}")
        d = d.join(post.withColumn("_k", person).drop(key), "_k")
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, row_id)]

    def run(batches):
        for pdf in pieces(batches, max(s.held for s in shapes.values())):
            out = {key: pdf[key], row_id: pdf[row_id]}
            for i, (m, s) in enumerate(shapes.items()):
                w = np.stack([np.ones(len(pdf)) if t == ONE else pdf[t].to_numpy(float) for t in s.terms], axis=1)
                y = pdf[s.ys].to_numpy(float)
                v, b = (np.stack(pdf[f"_m{i}_{c}"].to_list()) for c in ("v", "b"))
                out[m] = row_densities(s, w, y, v.reshape(len(pdf), s.q, s.q), b, params[m])
            yield pd.DataFrame(out)

    return d.mapInPandas(run, ", ".join([*kinds, *[f"`{m}` double" for m in fits]]))


def compare_rows(rows: DataFrame, moments: DataFrame, key: str, row_id: str, models: Mapping[str, Shape], *,
                 max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """Leave-observation-out comparison (M4), best first (O4): elpd, its standard error, difference to the best and its error.

    Every model is fitted once to all persons; a row's density is then taken
    with its person's effects estimated without it.
    """
    mom = write_through(moments)
    fits = {m: fit_many(mom, s, max_iter=max_iter, tol=tol)[0] for m, s in models.items()}
    ll = write_through(leave_row_out(rows, mom, key, row_id, fits))
    discard(mom)
    names = list(models)
    long = ll.select(F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("_l"),
                                                 F.array(*[F.col(f"`{x}`") for x in names]).alias("_all")) for m in names])))
    sums = ll.agg(*[F.sum(f"`{m}`").alias(m) for m in names]).first()
    best = max(range(len(names)), key=lambda i: (sums[i] is not None, sums[i]))
    away = F.col("_l") - F.get("_all", F.lit(best))
    done = F.lit(False)
    for m in names:
        done = F.when(F.col("model") == m, F.lit(bool(fits[m]["converged"]))).otherwise(done)
    n = F.count("*")
    return long.groupBy("model").agg(
        F.sum("_l").alias("elpd"), (F.stddev_samp("_l") * F.sqrt(n)).alias("se_elpd"), F.sum(away).alias("elpd_diff"),
        (F.stddev_samp(away) * F.sqrt(n)).alias("se_diff"), n.alias("rows")).withColumn("converged", done).orderBy(F.desc("elpd"), "model")
