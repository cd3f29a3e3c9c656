"""Gaussian linear hidden Markov models by variational Bayes.

Each state's emission is a Bayesian linear regression: y ~ N(mu_k + x beta_k, Sigma_k), with the mean and the
coefficients of each state, shared, or left out, and full, diagonal, shared or identity covariances. Sessions are
packed once into a row each and kept; an iteration is one pass over them: tasks run the recursions on batches of
sessions and emit one vector of sufficient statistics for each task, which Spark sums; the update of the
parameters is small algebra on the driver. Parameters travel with the task, never through a join."""

from __future__ import annotations

import copy
import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import chain
from ..functions.special import dirichlet_kl, digamma, gamma_kl, gauss1d_kl, gauss_kl, wishart_kl

COVARIANCES = ("shareddiag", "diag", "sharedfull", "full", "identity")
PARTS = ("state", "shared", "no")
#: Rows of sessions that a task recurses over at once.
BATCH_ROWS = 200_000


@dataclass
class Spec:
    """What a model is. connectivity: (p x q) mask of the coefficients that exist, for diagonal covariances only."""

    n_states: int
    covariance: str = "shareddiag"
    mean: str = "state"
    beta: str = "state"
    dirichlet_diag: float = 10.0
    connectivity: np.ndarray | None = None
    transitions: np.ndarray | None = None
    starts: np.ndarray | None = None

    def __post_init__(self):
        if self.covariance not in COVARIANCES or self.mean not in PARTS or self.beta not in PARTS:
            raise ValueError(f"covariance is one of {COVARIANCES}, mean and beta of {PARTS}")
        if self.connectivity is not None and not self.diagonal:
            raise ValueError("connectivity needs a diagonal covariance")
        k = self.n_states
        self.transitions = np.ones((k, k), bool) if self.transitions is None else np.asarray(self.transitions, bool)
        self.starts = np.ones(k, bool) if self.starts is None else np.asarray(self.starts, bool)

    diagonal = property(lambda s: s.covariance in ("shareddiag", "diag", "identity"))
    shared = property(lambda s: s.covariance in ("shareddiag", "sharedfull", "identity"))


@dataclass
class Options:
    """Of training. cycles of at most `cycles`; `starts` short runs of `start_cycles`, of which the best goes on; ends
    after `patience` cycles in a row whose relative gain is under tol; states with less than `least` summed
    probability are switched off. batch > 0: mini-batches of so many sessions."""

    cycles: int = 100
    starts: int = 5
    start_cycles: int = 10
    tol: float = 1e-4
    patience: int = 1
    least: float = 20.0
    deactivate: bool = True
    seed: int = 0
    batch: int = 0
    forget: float = 0.75
    base: float = 0.25


class Layout:
    """Names and places of the sufficient statistics in one flat vector."""

    def __init__(self, spec: Spec, p: int, q: int):
        k = spec.n_states
        shapes = {"loglik": (), "n_sessions": (), "n": (k,), "first": (k,), "xi": (k, k), "gy": (k, q), "gyy": (k, q) if spec.diagonal else (k, q, q)}
        if p:
            shapes |= {"gx": (k, p), "gxx": (k, p, p), "gxy": (k, p, q), "ggx": (k, k, p)}
        self.shapes, self.at, i = shapes, {}, 0
        for name, s in shapes.items():
            n = int(np.prod(s, dtype=int))
            self.at[name] = slice(i, i + n)
            i += n
        self.size = i

    def read(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[self.at[name]].reshape(s) for name, s in self.shapes.items()}

    def collect(self, y, x, gamma, xi, first, loglik, diagonal: bool) -> np.ndarray:
        out = np.zeros(self.size)
        v = self.read(out)
        v["loglik"][...], v["n_sessions"][...] = loglik, len(first)
        v["n"][:], v["first"][:], v["xi"][:] = gamma.sum(0), first.sum(0), xi
        v["gy"][:] = gamma.T @ y
        for k, g in enumerate(gamma.T):
            v["gyy"][k] = g @ (y * y) if diagonal else (y * g[:, None]).T @ y
            if x is not None:
                xg = x * g[:, None]
                v["gx"][k], v["gxx"][k], v["gxy"][k] = xg.sum(0), xg.T @ x, xg.T @ y
                v["ggx"][k] = gamma.T @ xg
        return out


@dataclass
class Model:
    spec: Spec
    p: int = 0
    q: int = 0
    sigma_rate: np.ndarray | None = None
    sigma_shape: np.ndarray | None = None
    prior_rate: np.ndarray | None = None
    prior_shape: float = 0.0
    mu: np.ndarray | None = None
    mu_cov: np.ndarray | None = None
    mu_ard: np.ndarray | None = None
    mu_ard_shape: float = 1e-4
    beta: np.ndarray | None = None
    beta_cov: np.ndarray | None = None
    beta_ard: np.ndarray | None = None
    beta_ard_shape: float = 1e-4
    alpha: np.ndarray | None = None
    alpha2: np.ndarray | None = None
    active: np.ndarray | None = None
    trace: list = field(default_factory=list)

    # Dynamics

    def start_prior(self) -> np.ndarray:
        return np.where(self.spec.starts, 1.0, 0.0)

    def move_prior(self) -> np.ndarray:
        k = self.spec.n_states
        d = np.ones((k, k))
        np.fill_diagonal(d, self.spec.dirichlet_diag)
        return np.where(self.spec.transitions, d, 0.0)

    def set_dynamics(self, first=None, xi=None, rho: float = 1.0) -> None:
        a, b = self.start_prior(), self.move_prior()
        if first is not None:
            a, b = np.where(a > 0, a + first, 0), np.where(b > 0, b + xi, 0)
        if rho < 1 and self.alpha is not None:
            a, b = rho * a + (1 - rho) * self.alpha, rho * b + (1 - rho) * self.alpha2
        self.alpha, self.alpha2 = a, b

    @staticmethod
    def _expected(a: np.ndarray) -> np.ndarray:
        on = a > 0
        e = np.where(on, np.exp(digamma(np.where(on, a, 1.0)) - digamma(a.sum(-1, keepdims=True))), 0.0)
        return e / e.sum(-1, keepdims=True)

    @property
    def starts(self) -> np.ndarray:
        return self._expected(self.alpha)

    @property
    def moves(self) -> np.ndarray:
        return self._expected(self.alpha2)

    # Emissions

    def _of(self, part: str, k: int) -> int:
        return k if {"mean": self.spec.mean, "beta": self.spec.beta}[part] == "state" else 0

    def _sig(self, k: int) -> int:
        return 0 if self.spec.shared else k

    def precision(self, k: int) -> np.ndarray:
        """Expected precision: a vector if covariances are diagonal."""
        i = self._sig(k)
        if self.spec.covariance == "identity":
            return np.ones(self.q)
        if self.spec.diagonal:
            return self.sigma_shape[i] / self.sigma_rate[i]
        return self.sigma_shape[i] * np.linalg.inv(self.sigma_rate[i])

    def cov(self, k: int) -> np.ndarray:
        """Expected noise covariance."""
        i = self._sig(k)
        if self.spec.covariance == "identity":
            return np.eye(self.q)
        return np.diag(self.sigma_rate[i] / self.sigma_shape[i]) if self.spec.diagonal else self.sigma_rate[i] / self.sigma_shape[i]

    def _used(self, j: int) -> np.ndarray:
        c = self.spec.connectivity
        return np.arange(self.p) if c is None else np.flatnonzero(np.asarray(c)[:, j] == 1)

    def loglik(self, y: np.ndarray, x: np.ndarray | None) -> np.ndarray:
        """Expected log density of each row in each state, with the parameters' uncertainty."""
        q, out = self.q, np.empty((len(y), self.spec.n_states))
        for k in range(self.spec.n_states):
            if self.active is not None and not self.active[k]:
                out[:, k] = -1e300
                continue
            c, i = self.precision(k), self._sig(k)
            if self.spec.covariance == "identity":
                logdet = 0.0
            elif self.spec.diagonal:
                logdet = 0.5 * (q * digamma(self.sigma_shape[i]) - np.log(self.sigma_rate[i]).sum())
            else:
                logdet = 0.5 * (digamma(0.5 * (self.sigma_shape[i] - np.arange(q))).sum() - np.linalg.slogdet(self.sigma_rate[i])[1])
            d, spread = y, 0.0
            if self.mu is not None:
                m = self._of("mean", k)
                d = d - self.mu[m]
                spread = -0.5 * ((c * self.mu_cov[m]).sum())
            if self.beta is not None:
                b = self._of("beta", k)
                d = d - x @ self.beta[b]
                spread = spread - 0.5 * ((x @ self._row_form(b, c)) * x).sum(1)
            dist = -0.5 * ((d * c) * d if self.spec.diagonal else (d @ c) * d).sum(1)
            out[:, k] = dist + spread + logdet - 0.5 * q * np.log(2 * np.pi)
        return out

    def _row_form(self, b: int, c: np.ndarray) -> np.ndarray:
        """The (p x p) matrix A with x'Ax = trace(precision Cov(x beta))."""
        if self.spec.diagonal:
            return np.einsum("j,jab->ab", c, self.beta_cov[b])
        s = self.beta_cov[b].reshape(self.p, self.q, self.p, self.q)
        return np.einsum("ij,aibj->ab", c, s)

    # The update

    def set_up(self, p: int, q: int, prior_range: np.ndarray) -> None:
        s = self.spec
        self.p, self.q = (p if s.beta != "no" else 0), q
        if s.covariance == "identity":
            self.prior_rate, self.prior_shape = np.ones(q), 1.0
        elif s.diagonal:
            self.prior_rate, self.prior_shape = 0.5 * prior_range, 0.5 * (q + 0.1 - 1)
        else:
            self.prior_rate, self.prior_shape = np.diag(prior_range), q + 0.1 - 1
        n = 1 if s.shared else s.n_states
        self.sigma_rate, self.sigma_shape = np.repeat(self.prior_rate[None], n, 0), np.full(n, self.prior_shape)
        if s.mean != "no":
            n = s.n_states if s.mean == "state" else 1
            self.mu, self.mu_ard = np.zeros((n, q)), np.full((n, q), 0.1)
            self.mu_cov = np.full((n, q), 0.01) if s.diagonal else np.repeat(0.01 * np.eye(q)[None], n, 0)
        if s.beta != "no":
            n = s.n_states if s.beta == "state" else 1
            self.beta, self.beta_ard = np.zeros((n, p, q)), np.full((n, p, q), 0.1)
            self.beta_cov = np.broadcast_to(0.01 * np.eye(p), (n, q, p, p)).copy() if s.diagonal else np.repeat(0.01 * np.eye(p * q)[None], n, 0)
        self.active = np.ones(s.n_states, bool)

    def update(self, st: dict[str, np.ndarray], factor: float = 1.0, rho: float = 1.0) -> None:
        """One conjugate pass over means, coefficients, covariances and their scales, from statistics alone."""
        s = self.spec
        blend = lambda new, old: rho * new + (1 - rho) * old
        groups = lambda part: [[k] for k in range(s.n_states)] if part == "state" else [list(range(s.n_states))]
        if self.mu is not None:
            for m, ks in enumerate(groups(s.mean)):
                if s.mean == "state" and not self.active[m]:
                    continue
                n, gy = st["n"][ks].sum(), st["gy"][ks].sum(0)
                if self.beta is not None:
                    for k in range(s.n_states):
                        # with a shared mean the weights of all states sum to one
                        weight = st["ggx"][ks[0], k] if s.mean == "state" and s.beta == "state" else (st["gx"][k] if s.mean == "shared" and s.beta == "state" else None)
                        if weight is not None:
                            gy = gy - weight @ self.beta[k]
                    if s.beta == "shared":
                        gy = gy - st["gx"][ks].sum(0) @ self.beta[0]
                c, ard = self.precision(ks[0]), self.mu_ard_shape / self.mu_ard[m]
                if s.diagonal:
                    cov = 1 / (factor * n * c + ard)
                    mu = factor * cov * c * gy
                else:
                    cov = np.linalg.inv(factor * n * c + np.diag(ard))
                    mu = factor * cov @ (c @ gy)
                self.mu_cov[m], self.mu[m] = blend(cov, self.mu_cov[m]), blend(mu, self.mu[m])
        if self.beta is not None:
            for b, ks in enumerate(groups(s.beta)):
                if s.beta == "state" and not self.active[b]:
                    continue
                gxx, gxy = st["gxx"][ks].sum(0), st["gxy"][ks].sum(0)
                if self.mu is not None:
                    if s.mean == "shared":
                        gxy = gxy - np.outer(st["gx"][ks].sum(0), self.mu[0])
                    elif s.beta == "state":
                        gxy = gxy - st["ggx"][ks[0]].T @ self.mu
                    else:
                        gxy = gxy - st["gx"].T @ self.mu
                c, ard = self.precision(ks[0]), self.beta_ard_shape / self.beta_ard[b]
                if s.diagonal:
                    for j in range(self.q):
                        on = self._used(j)
                        at = np.ix_(on, on)
                        cov = np.linalg.inv(factor * c[j] * gxx[at] + np.diag(ard[on, j]))
                        self.beta[b][on, j] = blend(cov @ (factor * c[j] * gxy[on, j]), self.beta[b][on, j])
                        full = np.zeros((self.p, self.p))
                        full[at] = cov
                        self.beta_cov[b, j] = blend(full, self.beta_cov[b, j])
                else:
                    cov = np.linalg.inv(factor * np.kron(gxx, c) + np.diag(ard.ravel()))
                    self.beta_cov[b] = blend(cov, self.beta_cov[b])
                    self.beta[b] = blend((factor * cov @ (gxy @ c).ravel()).reshape(self.p, self.q), self.beta[b])
        if s.covariance != "identity":
            half = 0.5 if s.diagonal else 1.0
            scatter = [self._scatter(st, k) for k in range(s.n_states)]
            for i, ks in enumerate([list(range(s.n_states))] if s.shared else [[k] for k in range(s.n_states)]):
                rate = self.prior_rate + half * factor * sum(scatter[k] for k in ks)
                shape = self.prior_shape + half * factor * st["n"][ks].sum()
                self.sigma_rate[i], self.sigma_shape[i] = blend(rate, self.sigma_rate[i]), blend(shape, self.sigma_shape[i])
        self._rescale()

    def _scatter(self, st: dict[str, np.ndarray], k: int) -> np.ndarray:
        """Expected sum of outer products (or squares) of a state's residuals."""
        diag, n = self.spec.diagonal, st["n"][k]
        out = st["gyy"][k].copy()
        outer = (lambda a, b: a * b) if diag else np.outer
        mu = self.mu[self._of("mean", k)] if self.mu is not None else np.zeros(self.q)
        if self.mu is not None:
            out -= outer(st["gy"][k], mu) + outer(mu, st["gy"][k]) - n * outer(mu, mu)
            out += n * self.mu_cov[self._of("mean", k)]
        if self.beta is not None:
            b = self._of("beta", k)
            beta, gx, gxx, gxy = self.beta[b], st["gx"][k], st["gxx"][k], st["gxy"][k]
            fit = gx @ beta
            if diag:
                out += -2 * (beta * gxy).sum(0) + (beta * (gxx @ beta)).sum(0) + 2 * mu * fit
                out += np.einsum("jab,ab->j", self.beta_cov[b], gxx)
            else:
                cross = beta.T @ gxy
                out += -cross - cross.T + beta.T @ gxx @ beta + np.outer(mu, fit) + np.outer(fit, mu)
                out += np.einsum("aibj,ab->ij", self.beta_cov[b].reshape(self.p, self.q, self.p, self.q), gxx)
        return out

    def _rescale(self) -> None:
        """Scales of the priors on means and coefficients."""
        if self.mu is not None:
            var = self.mu_cov if self.spec.diagonal else np.diagonal(self.mu_cov, axis1=1, axis2=2)
            self.mu_ard, self.mu_ard_shape = 0.1 + 0.5 * var + self.mu**2, 0.6
        if self.beta is not None:
            var = np.diagonal(self.beta_cov, axis1=2, axis2=3).transpose(0, 2, 1) if self.spec.diagonal else np.diagonal(self.beta_cov, axis1=1, axis2=2).reshape(self.beta.shape)
            self.beta_ard, self.beta_ard_shape = 0.1 + 0.5 * (var + self.beta**2), 0.6

    # Free energy

    def divergences(self) -> tuple[float, float]:
        """KL of the dynamics and of the emissions from their priors."""
        s = self.spec
        dyn = dirichlet_kl(self.alpha, self.start_prior()) + sum(dirichlet_kl(a, b) for a, b in zip(self.alpha2, self.move_prior()))
        obs = 0.0
        if self.mu is not None:
            for m in range(len(self.mu)):
                prior = self.mu_ard[m] / self.mu_ard_shape
                obs += gauss1d_kl(self.mu[m], self.mu_cov[m], 0, prior).sum() if s.diagonal else gauss_kl(self.mu[m], self.mu_cov[m], np.zeros(self.q), np.diag(prior))
                obs += gamma_kl(self.mu_ard_shape, self.mu_ard[m], 0.1, 0.1).sum()
        if self.beta is not None:
            for b in range(len(self.beta)):
                if s.diagonal:
                    for j in range(self.q):
                        on = self._used(j)
                        obs += gauss_kl(self.beta[b][on, j], self.beta_cov[b, j][np.ix_(on, on)], np.zeros(len(on)), np.diag(self.beta_ard[b][on, j] / self.beta_ard_shape))
                        obs += gamma_kl(self.beta_ard_shape, self.beta_ard[b][on, j], 0.1, 0.1).sum()
                else:
                    obs += gauss_kl(self.beta[b].ravel(), self.beta_cov[b], np.zeros(self.p * self.q), np.diag(self.beta_ard[b].ravel() / self.beta_ard_shape))
                    obs += gamma_kl(self.beta_ard_shape, self.beta_ard[b], 0.1, 0.1).sum()
        if s.covariance != "identity":
            for rate, shape in zip(self.sigma_rate, self.sigma_shape):
                obs += gamma_kl(shape, rate, self.prior_shape, self.prior_rate).sum() if s.diagonal else wishart_kl(shape, rate, self.prior_shape, self.prior_rate)
        return float(dyn), float(obs)

    # Keeping

    def to_json(self) -> str:
        enc = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        d = asdict(self)
        d["spec"] = {k: enc(v) for k, v in d["spec"].items()}
        return json.dumps({k: enc(v) for k, v in d.items()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        spec = d.pop("spec")
        if spec["connectivity"] is not None:
            spec["connectivity"] = np.array(spec["connectivity"])
        arr = {k: np.array(v) if isinstance(v, list) and k != "trace" else v for k, v in d.items()}
        return cls(Spec(**spec), **arr)

    @classmethod
    def from_mat(cls, variables: dict) -> Model:
        """A model saved from MATLAB (as `sources.matfile.read` gives it), itself or in a variable hmm. Means and
        coefficients are rows of each state's W, the mean's first; they have coefficients if there are more rows."""
        h = variables if "K" in variables else variables["hmm"]
        one = lambda v: float(np.ravel(v)[0])
        k, train = int(one(h["K"])), h["train"]
        states = [h["state"]] if isinstance(h["state"], dict) else list(np.ravel(h["state"]))
        has_mean, cov = not int(one(train["zeromean"])), str(train["covtype"])
        w = states[0].get("W")
        rows = 0 if w is None else np.atleast_2d(w["Mu_W"]).shape[0]
        prior = h["prior"]["Omega"] if "Omega" in h.get("prior", {}) else states[0]["prior"]["Omega"]
        spec = Spec(k, cov, "state" if has_mean else "no", "state" if rows > has_mean else "no", one(train["DirichletDiag"]) if "DirichletDiag" in train else 10.0)
        spec.transitions = np.reshape(train["Pstructure"], (k, k)).astype(bool) if "Pstructure" in train else spec.transitions
        spec.starts = np.ravel(train["Pistructure"]).astype(bool) if "Pistructure" in train else spec.starts
        s = np.atleast_2d(np.asarray(train["S"], float)) if "S" in train else None
        if spec.diagonal and s is not None and spec.beta != "no" and s.shape == (rows - has_mean, np.atleast_2d(w["Mu_W"]).shape[1]):
            spec.connectivity = s
        rate = np.asarray(prior["Gam_rate"], float)
        q = rate.size if spec.diagonal else rate.shape[0]
        m = cls(spec)
        p = rows - has_mean
        m.set_up(p, q, np.ones(q))
        m.prior_rate, m.prior_shape = np.ravel(rate) if spec.diagonal else rate, one(prior["Gam_shape"])
        noise = [h["Omega"]] if spec.shared else [s["Omega"] for s in states]
        m.sigma_rate = np.array([np.ravel(o["Gam_rate"]) if spec.diagonal else np.asarray(o["Gam_rate"], float) for o in noise], float)
        m.sigma_shape = np.array([one(o["Gam_shape"]) for o in noise])
        for i, state in enumerate(states if w is not None else []):
            mu = np.asarray(state["W"]["Mu_W"], float).reshape(rows, q)
            s_w = np.asarray(state["W"]["S_W"], float)
            s_w = s_w.reshape(q, rows, rows) if spec.diagonal else s_w.reshape(rows * q, rows * q)
            if has_mean:
                m.mu[i], m.mu_cov[i] = mu[0], s_w[:, 0, 0] if spec.diagonal else s_w[:q, :q]
            if m.beta is not None:
                j = int(has_mean)
                m.beta[i], m.beta_cov[i] = mu[j:], s_w[:, j:, j:] if spec.diagonal else s_w[j * q :, j * q :]
        m.alpha, m.alpha2 = np.ravel(np.asarray(h["Dir_alpha"], float)), np.reshape(np.asarray(h["Dir2d_alpha"], float), (k, k))
        return m

    def to_mat(self) -> dict:
        """The model as variables of a MAT file, in the form that `from_mat` reads."""
        s = self.spec
        if "shared" in (s.mean, s.beta) or s.covariance == "identity":
            raise ValueError("means and coefficients must be of states, with a covariance that is estimated")
        omega = lambda rate, shape: {"Gam_rate": rate, "Gam_shape": float(shape)}
        prior = omega(self.prior_rate, self.prior_shape)
        noise = [omega(r, n) for r, n in zip(self.sigma_rate, self.sigma_shape)]
        states = np.empty(s.n_states, object)
        for k in range(s.n_states):
            parts = ([self.mu[k][None]] if self.mu is not None else []) + ([self.beta[k]] if self.beta is not None else [])
            mu = np.concatenate(parts) if parts else np.zeros((0, self.q))
            n, a = len(mu), int(self.mu is not None)
            s_w = np.zeros((self.q, n, n) if s.diagonal else (n * self.q, n * self.q))
            if a and s.diagonal:
                s_w[:, 0, 0] = self.mu_cov[k]
            elif a:
                s_w[: self.q, : self.q] = self.mu_cov[k]
            if self.beta is not None and s.diagonal:
                s_w[:, a:, a:] = self.beta_cov[k]
            elif self.beta is not None:
                s_w[a * self.q :, a * self.q :] = self.beta_cov[k]
            states[k] = {"W": {"Mu_W": mu, "S_W": s_w}, "prior": {"Omega": prior}} | ({} if s.shared else {"Omega": noise[k]})
        train = {"covtype": s.covariance, "zeromean": float(s.mean == "no"), "DirichletDiag": s.dirichlet_diag, "Pstructure": s.transitions, "Pistructure": s.starts}
        train["S"] = np.ones((max(self.p, 1), self.q)) if s.connectivity is None else np.asarray(s.connectivity, float)
        out = {"K": float(s.n_states), "train": train, "state": states, "prior": {"Dir_alpha": 1.0}, "P": self.moves, "Pi": self.starts, "Dir_alpha": self.alpha, "Dir2d_alpha": self.alpha2}
        return {"hmm": out | ({"Omega": noise[0]} if s.shared else {})}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, state, i, j, value): means, coefficients, covariances, transitions and starts as a long table."""
        rows = []
        for k in range(self.spec.n_states):
            if self.mu is not None:
                rows += [("mean", k, i, 0, float(v)) for i, v in enumerate(self.mu[self._of("mean", k)])]
            if self.beta is not None:
                rows += [("beta", k, i, j, float(v)) for (i, j), v in np.ndenumerate(self.beta[self._of("beta", k)])]
            rows += [("covariance", k, i, j, float(v)) for (i, j), v in np.ndenumerate(self.cov(k))]
            rows += [("transition", k, j, 0, float(v)) for j, v in enumerate(self.moves[k])] + [("start", k, 0, 0, float(self.starts[k]))]
        return spark.createDataFrame(rows, "name string, state int, i int, j int, value double")


# Sessions


def packed(obs: DataFrame) -> DataFrame:
    """One row for each session: session_id and rows, its (t, y, x) in order of t."""
    x = F.col("x") if "x" in obs.columns else F.lit(None).cast("array<double>")
    return obs.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", F.col("y").cast("array<double>").alias("y"), x.alias("x")))).alias("rows"))


def _numbers(lists) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix; nulls are NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def _opened(batch):
    """(place in the batch, y, x, t) of each packed row of an Arrow batch, as views of its buffers, or of a frame's rows."""
    if not hasattr(batch, "schema"):
        for i, rows in enumerate(batch["rows"]):
            yield i, np.array([r["y"] for r in rows], float), None if rows[0]["x"] is None else np.array([r["x"] for r in rows], float), np.array([r["t"] for r in rows], np.int32)
        return
    column = batch.column(batch.schema.get_field_index("rows"))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if not len(ends) or not ends[-1]:
        return
    t, y, x = column.flatten().flatten()
    t, y, x = t.to_numpy(zero_copy_only=False).astype(np.int32), _numbers(y), None if x.null_count else _numbers(x)
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        yield i, y[a:b], None if x is None else x[a:b], t[a:b]


def _batches(batches):
    """Lists of (session id, y, x, t) that hold up to BATCH_ROWS rows when all are padded to the longest."""
    held, longest = [], 0
    for b in batches:
        ids = b.column(b.schema.get_field_index("session_id")).to_pylist() if hasattr(b, "schema") else list(b["session_id"])
        for i, y, x, t in _opened(b):
            if held and (len(held) + 1) * max(longest, len(y)) > BATCH_ROWS:
                yield held
                held, longest = [], 0
            held.append((ids[i], y, x, t))
            longest = max(longest, len(y))
    if held:
        yield held


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _lists(rows: np.ndarray, kind):
    """Rows of a matrix as an Arrow array of lists."""
    import pyarrow as pa

    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind.value_type), type=kind)


def _told(schema, *columns):
    """A record batch; matrices become lists."""
    import pyarrow as pa

    made = [c.cast(f.type) if isinstance(c, pa.Array) else _lists(c, f.type) if getattr(c, "ndim", 1) == 2 else pa.array(c, f.type) for f, c in zip(schema, columns)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _repeated(ids: list, lengths):
    """Each id as often as its session has rows."""
    import pyarrow as pa

    return pa.array(ids).take(pa.array(np.repeat(np.arange(len(ids)), lengths)))


def _seed(seed: int, sid) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(str(sid).encode())])


def _liks(model: Model, batch) -> list[np.ndarray]:
    """Log densities of each session's rows, computed for all rows at once. Batch entries end in y, x, t."""
    ys, xs = [b[-3] for b in batch], [b[-2] for b in batch]
    out = model.loglik(np.concatenate(ys), None if xs[0] is None else np.concatenate(xs))
    return np.split(out, np.cumsum([len(y) for y in ys])[:-1])


def _posterior(model: Model, batch):
    padded, lengths, order = chain.pad(_liks(model, batch))
    gamma, xi, ll = chain.smooth(padded, lengths, model.moves, model.starts)
    back = np.argsort(order)
    return [gamma[i, : lengths[i]] for i in back], xi[back], ll[back]


def _posteriors(models: list[Model], batch):
    """(place, posterior) of each model. Models with as many states go through the recursions side by side, as many as
    BATCH_ROWS rows hold."""
    room = max(1, BATCH_ROWS // max(1, len(batch) * max(len(b[-3]) for b in batch)))
    for k in sorted({m.spec.n_states for m in models}):
        alike = [n for n, m in enumerate(models) if m.spec.n_states == k]
        for at in range(0, len(alike), room):
            some = alike[at : at + room]
            padded, lengths, order = chain.pad([v for n in some for v in _liks(models[n], batch)])
            of = np.repeat(np.arange(len(some)), len(batch))[order]
            gamma, xi, ll = chain.smooth(padded, lengths, np.stack([models[n].moves for n in some])[of], np.stack([models[n].starts for n in some])[of])
            back = np.argsort(order)
            for i, n in enumerate(some):
                own = back[i * len(batch) : (i + 1) * len(batch)]
                yield n, ([gamma[j, : lengths[j]] for j in own], xi[own], ll[own])


def _guess(model: Model, batch, seed: int):
    """Sampled paths as posteriors, and the pair counts that follow from them."""
    k, p, pi = model.spec.n_states, model.moves, model.starts
    gammas = [np.eye(k)[chain.sample_chain(len(y), p, pi, _seed(seed, sid))] for sid, y, _, _ in batch]
    return gammas, np.stack([g[:-1].T @ g[1:] for g in gammas]), np.zeros(len(gammas))


def statistics(sessions: DataFrame, model: Model, seed: int | None = None, per_session: bool = False):
    """Sufficient statistics under the model's posterior (or sampled paths if a seed is given), summed over all
    sessions: one vector leaves each task. per_session: a DataFrame (session_id, stats) and no sum."""
    layout, diag = Layout(model.spec, model.p, model.q), model.spec.diagonal

    def of(batch):
        return _posterior(model, batch) if seed is None else _guess(model, batch, seed)

    if per_session:
        kind = dict(sessions.dtypes)["session_id"]
        ddl = f"session_id {kind}, stats array<double>"
        out = _arrow(ddl)

        def rows(batches):
            for batch in _batches(batches):
                each = [layout.collect(y, x if model.p else None, g, z, g[:1], v, diag) for (_, y, x, _), g, z, v in zip(batch, *of(batch))]
                yield _told(out, [s for s, *_ in batch], np.stack(each))

        return sessions.mapInArrow(rows, ddl)

    return _statistics_of(sessions, [model], None if seed is None else [seed])[0]


def _statistics_of(sessions: DataFrame, models: list[Model], seeds: list[int] | None = None) -> list[dict[str, np.ndarray]]:
    """Sums of the sufficient statistics of each model, all from one pass."""
    layouts, sums = [Layout(m.spec, m.p, m.q) for m in models], _arrow("i int, v double")
    ends = np.cumsum([layout.size for layout in layouts])

    def total(batches):
        s = np.zeros(ends[-1])
        for batch in _batches(batches):
            y = np.concatenate([y for _, y, _, _ in batch])
            x = np.concatenate([x for _, _, x, _ in batch]) if models[0].p else None
            found = ((n, _guess(m, batch, seeds[n])) for n, m in enumerate(models)) if seeds is not None else _posteriors(models, batch) if len(models) > 1 else [(0, _posterior(models[0], batch))]
            for n, (gammas, xi, ll) in found:
                layout, first = layouts[n], np.stack([g[0] for g in gammas])
                s[ends[n] - layout.size : ends[n]] += layout.collect(y, x, np.concatenate(gammas), xi.sum(0), first, ll.sum(), models[n].spec.diagonal)
        yield _told(sums, np.arange(len(s)), s)

    flat = np.zeros(ends[-1])
    for r in sessions.mapInArrow(total, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    return [layout.read(part) for layout, part in zip(layouts, np.split(flat, ends[:-1]))]


def _prior_range(sessions: DataFrame, spec: Spec, p: int, q: int) -> np.ndarray:
    """Range of each channel less its mean and its ridge regression on x: two aggregations."""
    from . import preprocess

    flat = sessions.select(F.explode("rows").alias("r")).select("r.y", "r.x")
    if spec.beta != "no":
        gxx, sx, _, n = preprocess.gram(flat, "x")
        gxy, _, sy, _ = preprocess.gram(flat, "x", "y")
        mean = sy / n if spec.mean != "no" else np.zeros(q)
        beta = np.linalg.solve(gxx + 0.1 * np.eye(p), gxy - np.outer(sx, mean))
        fit = [F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in beta[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(q)]
        cols = [F.col("y")[j] - fit[j] for j in range(q)]
    else:
        cols = [F.col("y")[j] for j in range(q)]
    row = flat.agg(*(F.max(c).alias(f"a{j}") for j, c in enumerate(cols)), *(F.min(c).alias(f"b{j}") for j, c in enumerate(cols))).first()
    return np.array([row[f"a{j}"] - row[f"b{j}"] for j in range(q)], float)


def _shape_of(obs: DataFrame) -> tuple[int, int]:
    row = obs.select(F.size("y").alias("q"), (F.size("x") if "x" in obs.columns else F.lit(0)).alias("p")).first()
    if row is None:
        raise ValueError("there are no observations")
    return max(0, row["p"]), row["q"]


def train(obs: DataFrame, spec: Spec, options: Options | None = None) -> Model:
    """Fit a model. The trace holds the free energy of each cycle."""
    o = options or Options()
    p, q = _shape_of(obs)
    if spec.beta != "no" and not p:
        raise ValueError("beta needs regressors x")
    sessions = packed(obs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fresh = Model(spec)
        fresh.set_up(p, q, _prior_range(sessions, spec, p, q))
        if o.batch:
            return _train_batches(sessions, fresh, o)
        return _fitted(sessions, [fresh], [o])[0][0]
    finally:
        sessions.unpersist()


def _fitted(sessions: DataFrame, fresh: list[Model], options: list[Options]) -> list[tuple[Model, bool]]:
    """Each model, fitted from the best of its starts, and whether it converged. A pass serves all that have not come to their end."""
    tries = [(n, i) for n, o in enumerate(options) for i in range(max(1, o.starts))]
    runs = _firsts(sessions, [fresh[n] for n, _ in tries], [options[n].seed * 1000 + i for n, i in tries])
    _cycles(sessions, runs, [options[n].start_cycles if options[n].starts else 0 for n, _ in tries], [options[n] for n, _ in tries])
    best = [min((m for m, (k, _) in zip(runs, tries) if k == n), key=lambda m: m.trace[-1] if m.trace else np.inf) for n in range(len(fresh))]
    return list(zip(best, _cycles(sessions, best, [o.cycles for o in options], options)))


def _firsts(sessions: DataFrame, fresh: list[Model], seeds: list[int]) -> list[Model]:
    models = [copy.deepcopy(m) for m in fresh]
    for m in models:
        m.set_dynamics()
    for m, st in zip(models, _statistics_of(sessions, models, seeds)):
        m.set_dynamics(st["first"], st["xi"])
        m.update(st)
    return models


def _cycles(sessions: DataFrame, models: list[Model], cycles: list[int], options: list[Options]) -> list[bool]:
    """Cycles of each model, up to its number of them; whether each converged."""
    small, ended = [0] * len(models), [False] * len(models)
    for c in range(max(cycles)):
        going = [n for n in range(len(models)) if c < cycles[n] and not ended[n]]
        if not going:
            break
        for n, st in zip(going, _statistics_of(sessions, [models[n] for n in going])):
            m, o = models[n], options[n]
            fe = float(-st["loglik"] + sum(m.divergences()))
            if not np.isfinite(fe):
                raise ValueError("training diverged: the free energy isn't a number")
            m.trace.append(fe)
            if len(m.trace) > 1:
                gain = (m.trace[-2] - fe) / max(abs(m.trace[0] - fe), 1e-12)
                small[n] = small[n] + 1 if abs(gain) < o.tol else 0
                if small[n] >= o.patience:
                    ended[n] = True
                    continue
            if o.deactivate and (st["n"] < o.least).any() and (st["n"] >= o.least).any():
                m.active = m.active & (st["n"] >= o.least)
            m.set_dynamics(st["first"], st["xi"])
            m.update(st)
    return ended


def _train_batches(sessions: DataFrame, fresh: Model, o: Options) -> Model:
    """Mini-batches: sessions drawn with less weight the more they were used, statistics scaled to all, steps of falling
    weight. How often each session was used is a table; a draw is the first rows in order of weighted hashes, so only
    the batch's ids are ever together."""
    from ..plans.lineage import cut

    uses = cut(sessions.select("session_id", F.lit(0).alias("used")))
    total = uses.count()
    m, n = None, min(o.batch, total)
    for it in range(o.cycles):
        least = uses.agg(F.min("used")).first()[0]
        # exponential of the weight's rate: the smallest are a draw without replacement by weight
        u = (F.pmod(F.xxhash64(F.lit(o.seed), F.lit(it), F.col("session_id")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        key = -F.ln(u) / F.pow(F.lit(float(o.base)), F.col("used") - F.lit(least))
        chosen = cut(uses.orderBy(key, "session_id").limit(n).select("session_id"))
        uses = cut(uses.join(F.broadcast(chosen.withColumn("one", F.lit(1))), "session_id", "left").select("session_id", (F.col("used") + F.coalesce("one", F.lit(0))).alias("used")))
        some = sessions.join(F.broadcast(chosen), "session_id", "left_semi")
        m = m or _firsts(some, [fresh], [o.seed])[0]
        rho, factor = (it + 2) ** -o.forget, total / n
        st = statistics(some, m)
        m.trace.append(float(-factor * st["loglik"] + sum(m.divergences())))
        m.set_dynamics(factor * st["first"], factor * st["xi"], rho)
        m.update(st, factor, rho)
    return m


# Uses of a model


def decode(obs: DataFrame, model: Model) -> DataFrame:
    """(session_id, t, gamma): state probabilities given the whole session."""

    ddl = f"session_id {dict(obs.dtypes)['session_id']}, t int, gamma array<double>"
    out = _arrow(ddl)

    def run(batches):
        for batch in _batches(batches):
            gammas, _, _ = _posterior(model, batch)
            yield _told(out, _repeated([b[0] for b in batch], [len(g) for g in gammas]), np.concatenate([b[3] for b in batch]), np.concatenate(gammas))

    return packed(obs).mapInArrow(run, ddl)


def viterbi(obs: DataFrame, model: Model) -> DataFrame:
    """(session_id, t, state): the most likely path of each session."""

    ddl = f"session_id {dict(obs.dtypes)['session_id']}, t int, state int"
    out = _arrow(ddl)

    def run(batches):
        for batch in _batches(batches):
            padded, lengths, order = chain.pad(_liks(model, batch))
            paths = chain.best_path(padded, lengths, model.moves, model.starts)
            yield _told(out, _repeated([batch[j][0] for j in order], lengths), np.concatenate([batch[j][3] for j in order]), np.concatenate([paths[i, :n] for i, n in enumerate(lengths)]))

    return packed(obs).mapInArrow(run, ddl)


def loglik(obs: DataFrame, model: Model) -> DataFrame:
    """(session_id, loglik): log-likelihood of each session, from the forward recursion."""

    ddl = f"session_id {dict(obs.dtypes)['session_id']}, loglik double"
    out = _arrow(ddl)

    def run(batches):
        for batch in _batches(batches):
            padded, lengths, order = chain.pad(_liks(model, batch))
            _, logc, _ = chain.forward(padded, lengths, model.moves, model.starts)
            yield _told(out, [batch[j][0] for j in order], logc.sum(1))

    return packed(obs).mapInArrow(run, ddl)


def entropy(obs: DataFrame, model: Model) -> DataFrame:
    """(session_id, entropy) of each session's states given the whole session."""

    ddl = f"session_id {dict(obs.dtypes)['session_id']}, entropy double"
    out = _arrow(ddl)

    def run(batches):
        for batch in _batches(batches):
            padded, lengths, order = chain.pad(_liks(model, batch))
            yield _told(out, [batch[j][0] for j in order], chain.entropy(padded, lengths, model.moves, model.starts))

    return packed(obs).mapInArrow(run, ddl)


def free_energy(obs: DataFrame, model: Model) -> dict[str, float]:
    """Data, dynamics and emission parts of the free energy, and their sum."""
    data = -float(loglik(obs, model).agg(F.sum("loglik")).first()[0])
    dyn, par = model.divergences()
    return {"data": data, "dynamics": dyn, "emissions": par, "total": data + dyn + par}


def sample(spark: SparkSession, sizes: DataFrame, model: Model, seed: int = 0, x: DataFrame | None = None) -> DataFrame:
    """(session_id, t, state, y): draws for sessions (session_id, n); x: (session_id, t, x) of the same rows if the
    model has coefficients. Each session's generator is seeded by the seed and its id."""
    kind = dict(sizes.dtypes)["session_id"]
    p, pi, beta = model.moves, model.starts, model.beta is not None
    if beta and x is None:
        raise ValueError("the model has coefficients: give x")
    roots = [np.linalg.cholesky(model.cov(k)) for k in range(model.spec.n_states)]

    ddl = f"session_id {kind}, t int, state int, y array<double>"
    out = _arrow(ddl)

    def drawn(sid, n: int, xs):
        r = _seed(seed, sid)
        path = chain.sample_chain(n, p, pi, r)
        noise = r.standard_normal((n, model.q))
        y = np.stack([roots[k] @ e for k, e in zip(path, noise)])
        if model.mu is not None:
            y += model.mu[[model._of("mean", k) for k in path]]
        if beta:
            y += np.stack([v @ model.beta[model._of("beta", k)] for v, k in zip(xs, path)])
        return path, y

    def told(held):
        ids, ts, made = zip(*held)
        return _told(out, _repeated(list(ids), [len(t) for t in ts]), np.concatenate(ts), np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))

    def run(batches):
        held, size = [], 0
        for b in batches:
            names, of = b.column(0).to_pylist(), _opened(b) if beta else ((i, None, None, np.arange(n, dtype=np.int32)) for i, n in enumerate(b.column(1).to_pylist()))
            for i, _, xs, t in of:
                if held and size + len(t) > BATCH_ROWS:
                    yield told(held)
                    held, size = [], 0
                if len(t):
                    held.append((names[i], t, drawn(names[i], len(t), xs)))
                    size += len(t)
        if held:
            yield told(held)

    if not beta:
        return sizes.select("session_id", F.col("n").cast("int").alias("n")).mapInArrow(run, ddl)
    rows = sizes.select("session_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("t")).join(x, ["session_id", "t"])
    return packed(rows.withColumn("y", F.array().cast("array<double>"))).mapInArrow(run, ddl)


def explained_variance(obs: DataFrame, gamma: DataFrame, model: Model) -> DataFrame:
    """(session_id, channel, r2): one less the squared residuals over those of the mean of all rows."""
    q, ks = model.q, range(model.spec.n_states)
    j = obs.join(gamma, ["session_id", "t"])
    mean = obs.agg(F.array(*(F.avg(F.col("y")[i]) for i in range(q))).alias("m")).first()["m"]

    def fit(k: int, i: int):
        out = F.lit(float(model.mu[model._of("mean", k)][i]) if model.mu is not None else 0.0)
        if model.beta is not None:
            for a, v in enumerate(model.beta[model._of("beta", k)][:, i]):
                out = out + F.col("x")[a] * float(v)
        return out

    sums = []
    for i in range(q):
        at = sum((F.col("gamma")[k] * fit(k, i) for k in ks), F.lit(0.0))
        sums.append(F.struct(F.lit(i).alias("channel"), (1 - F.sum((F.col("y")[i] - at) ** 2) / F.sum((F.col("y")[i] - float(mean[i])) ** 2)).alias("r2")))
    return j.groupBy("session_id").agg(F.array(*sums).alias("a")).select("session_id", F.explode("a").alias("r")).select("session_id", "r.*")


def session_models(obs: DataFrame, model: Model) -> DataFrame:
    """(session_id, model): a model for each session as JSON (`Model.from_json`): the group model's posterior, then one
    update from the session's own statistics. The updates run on the executors."""
    layout = Layout(model.spec, model.p, model.q)
    stats = statistics(packed(obs), model, per_session=True)

    def run(frames):
        for f in frames:
            out = []
            for flat in f["stats"]:
                m, st = copy.deepcopy(model), layout.read(np.array(flat))
                m.set_dynamics(st["first"], st["xi"])
                m.update(st)
                out.append(m.to_json())
            yield pd.DataFrame({"session_id": f["session_id"], "model": out})

    return stats.mapInPandas(run, f"session_id {dict(obs.dtypes)['session_id']}, model string")


def channel_table(spark: SparkSession, model: Model, axes: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """(name, state, i, j, value) of a model that was fitted on projected data, back in the channels: means, coefficients
    and covariances through the transposed axes (channels x components), with the projection's mean added to means."""
    rows = []
    for k in range(model.spec.n_states):
        if model.mu is not None:
            m = axes @ model.mu[model._of("mean", k)] + (0.0 if mean is None else mean)
            rows += [("mean", k, i, 0, float(v)) for i, v in enumerate(m)]
        if model.beta is not None:
            rows += [("beta", k, i, j, float(v)) for (i, j), v in np.ndenumerate(model.beta[model._of("beta", k)] @ axes.T)]
        rows += [("covariance", k, i, j, float(v)) for (i, j), v in np.ndenumerate(axes @ model.cov(k) @ axes.T)]
    return spark.createDataFrame(rows, "name string, state int, i int, j int, value double")


def pairs_of_gamma(gamma: DataFrame) -> DataFrame:
    """(session_id, i, j, xi): each session's pair probabilities of consecutive states, approximated from its state
    probabilities alone: products of neighbours summed over time, and divided by their sum."""
    from pyspark.sql import Window

    after = F.lead("gamma").over(Window.partitionBy("session_id").orderBy("t"))
    j = gamma.select("session_id", "gamma", after.alias("after")).where("after is not null")
    left = j.select("session_id", F.posexplode("gamma").alias("i", "a"), "after")
    both = left.select("session_id", "i", "a", F.posexplode("after").alias("j", "b"))
    s = both.groupBy("session_id", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return s.select("session_id", "i", "j", (F.col("s") / F.sum("s").over(Window.partitionBy("session_id"))).alias("xi"))


def state_regressions(obs: DataFrame, gamma: DataFrame, ridge: float = 0.1, centred: bool = True) -> DataFrame:
    """(state, i, j, beta): regression of y on x in each state, weighted by its probability; y is centred by its weighted
    mean first. One aggregation by state; the algebra is of p x p numbers a state."""
    w = obs.join(gamma, ["session_id", "t"]).select(F.posexplode("gamma").alias("state", "g"), "x", "y")

    def moments(frames):
        total: dict[int, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            x, y, g = np.stack(f["x"].to_numpy()), np.stack(f["y"].to_numpy()), f["g"].to_numpy()
            for k in np.unique(f["state"]):
                at = (f["state"] == k).to_numpy()
                v = np.column_stack([x[at], np.ones(at.sum()), y[at]])
                total[int(k)] = total.get(int(k), 0) + (v * g[at][:, None]).T @ v
        for k, m in total.items():
            yield pd.DataFrame({"state": k, "size": len(m), "i": np.arange(m.size), "v": m.ravel()})

    p, q = _shape_of(obs)
    sums: dict[int, np.ndarray] = {}
    for r in w.mapInPandas(moments, "state int, size int, i int, v double").groupBy("state", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["state"], np.zeros((p + 1 + q) ** 2))[r["i"]] = r["v"]
    rows = []
    for k, flat in sorted(sums.items()):
        m = flat.reshape(p + 1 + q, -1)
        mean = m[p, p + 1 :] / m[p, p] if centred else np.zeros(q)
        beta = np.linalg.solve(m[:p, :p] + ridge * np.eye(p), m[:p, p + 1 :] - np.outer(m[:p, p], mean))
        rows += [(k, i, j, float(b)) for (i, j), b in np.ndenumerate(beta)]
    return obs.sparkSession.createDataFrame(rows, "state int, i int, j int, beta double")


def sweep(obs: DataFrame, states: list[int], repeats: int, spec: Spec, options: Options | None = None) -> DataFrame:
    """(n_states, repeat, free_energy, cycles, converged, similarity): similarity is that of the run's posterior to the
    first repeat's with as many states, and null for the first. All runs are trained together: a pass over the sessions serves
    each model that goes on, and another one compares all posteriors."""
    kw = {f: getattr(spec, f) for f in ("covariance", "mean", "beta", "dirichlet_diag", "connectivity")}
    runs = [(k, rep) for k in states for rep in range(repeats)]
    each = [copy.copy(options or Options()) for _ in runs]
    for o, (_, rep) in zip(each, runs):
        o.seed = o.seed + 97 * rep
    p, q = _shape_of(obs)
    if spec.beta != "no" and not p:
        raise ValueError("beta needs regressors x")
    # so many parts that each core works on one, as a part costs the recursions' steps once for each model
    parts = max(obs.sparkSession.sparkContext.defaultParallelism, -(-obs.count() // BATCH_ROWS))
    sessions = packed(obs).repartition(parts, "session_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        most, fresh = _prior_range(sessions, spec, p, q), []
        for k, _ in runs:
            fresh.append(Model(Spec(k, **kw)))
            fresh[-1].set_up(p, q, most)
        if each[0].batch:
            made = [_train_batches(sessions, m, o) for m, o in zip(fresh, each)]
            fitted = [(m, len(m.trace) < o.cycles) for m, o in zip(made, each)]
        else:
            fitted = _fitted(sessions, fresh, each)
        alike = _similarities(sessions, {k: [m for (m, _), (n, _) in zip(fitted, runs) if n == k] for k in states})
    finally:
        sessions.unpersist()
    rows = [(k, rep, m.trace[-1], len(m.trace), bool(ended), alike.get((k, rep))) for (k, rep), (m, ended) in zip(runs, fitted)]
    return obs.sparkSession.createDataFrame(rows, "n_states int, repeat int, free_energy double, cycles int, converged boolean, similarity double")


def _similarities(sessions: DataFrame, models: dict[int, list[Model]]) -> dict[tuple[int, int], float]:
    """Of each number of states and repeat after the first: the similarity of its posterior to the first one's, as
    `summary.similarity`. One pass: tasks sum the minima of both posteriors' states."""
    from . import summary

    pairs = [(k, rep) for k, own in models.items() for rep in range(1, len(own))]
    ends, out = np.cumsum([1, *(k * k for k, _ in pairs)]), _arrow("i int, v double")

    def total(batches):
        s = np.zeros(ends[-1])
        for batch in _batches(batches):
            for k, own in models.items():
                first = np.concatenate(_posterior(own[0], batch)[0])
                for rep in range(1, len(own)):
                    other, at = np.concatenate(_posterior(own[rep], batch)[0]), pairs.index((k, rep))
                    s[ends[at] : ends[at + 1]] += np.concatenate([np.minimum(first[:, i, None], other).sum(0) for i in range(k)])
            s[0] += sum(len(y) for _, y, _, _ in batch)
        yield _told(out, np.arange(len(s)), s)

    if not pairs:
        return {}
    flat = np.zeros(ends[-1])
    for r in sessions.mapInArrow(total, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    each = {}
    for at, (k, rep) in enumerate(pairs):
        m = flat[ends[at] : ends[at + 1]].reshape(k, k) / flat[0]
        each[k, rep] = float(m[np.arange(k), summary.assign(-m)].sum())
    return each


def selection(swept: DataFrame) -> DataFrame:
    """(n_states, similarity, free_energy, bend): mean similarity of the repeats after the first to it, least free energy, and its
    second difference, which needs the numbers of states on both sides."""
    from pyspark.sql import Window

    a = swept.groupBy("n_states").agg(F.avg("similarity").alias("similarity"), F.min("free_energy").alias("free_energy"))
    w = Window.orderBy("n_states")  # a row for each number of states
    return a.withColumn("bend", F.lag("free_energy").over(w) - 2 * F.col("free_energy") + F.lead("free_energy").over(w))
