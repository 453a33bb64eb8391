"""The small routing learner: a shared layer and three heads in numpy, applied over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUTES = ("SELF", "ORACLE", "HYBRID")
OUT = T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("routing", T.StringType()), T.StructField("error", T.IntegerType())])


def init(inputs: int = 11, hidden: int = 32, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    return {"w1": w(inputs, hidden), "b1": np.zeros(hidden), "wc": w(hidden, 1), "bc": np.zeros(1), "wr": w(hidden, 3), "br": np.zeros(3), "we": w(hidden, 5), "be": np.zeros(5)}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def forward(p: dict[str, np.ndarray], x: np.ndarray):
    h = np.maximum(x @ p["w1"] + p["b1"], 0)
    return h, 1 / (1 + np.exp(-(h @ p["wc"] + p["bc"])))[:, 0], _softmax(h @ p["wr"] + p["br"]), _softmax(h @ p["we"] + p["be"])


def predict(features: Column, params: dict[str, np.ndarray]) -> Column:
    """Confidence, routing and error type of feature arrays; a null array gives nulls."""

    @F.pandas_udf(OUT)
    def run(x: pd.Series) -> pd.DataFrame:
        ok = x.notna()
        out = pd.DataFrame({"confidence": [None] * len(x), "routing": [None] * len(x), "error": [None] * len(x)}, index=x.index)
        if ok.any():
            _, c, r, e = forward(params, np.array(x[ok].tolist(), dtype=float))
            out.loc[ok, "confidence"], out.loc[ok, "routing"], out.loc[ok, "error"] = c, [ROUTES[i] for i in r.argmax(1)], e.argmax(1)
        return out.astype({"confidence": "float64"})

    return run(features)


def score(rows: DataFrame, key: str, features: str, params: dict[str, np.ndarray]) -> DataFrame:
    """(key, confidence, routing, error) of rows with a feature array; rows with a null array are left out."""

    def run(batches):
        for b in batches:
            if len(b):
                _, c, r, e = forward(params, np.array(b[features].tolist(), dtype=float))
                yield pd.DataFrame({key: b[key], "confidence": c, "routing": [ROUTES[i] for i in r.argmax(1)], "error": e.argmax(1)})

    schema = T.StructType([rows.schema[key], *OUT.fields])
    return rows.select(key, features).filter(F.col(features).isNotNull()).mapInPandas(run, schema)


class OnlineLearner:
    """Weights with their optimiser (decoupled weight decay) and the number of updates, which can be saved and loaded.

    `learn` is called with the rows of a bounded buffer after each micro-batch: one step per `every` new rows once there are
    `least`, each on a sample that prefers recent rows (weight 1 + i / n).
    """

    def __init__(self, inputs: int, seed: int = 0, rate: float = 1e-2, decay: float = 1e-2, sample: int = 32):
        self.params = init(inputs, seed=seed)
        self.rate, self.decay, self.sample, self.updates, self.seen, self.used = rate, decay, sample, 0, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.losses: list[float] = []

    def step(self, x: np.ndarray, confidence: np.ndarray, routing: np.ndarray, error: np.ndarray) -> float:
        loss, g = gradients(self.params, x, confidence, routing, error)
        self.updates += 1
        for k, v in g.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * v
            self.second[k] = 0.999 * self.second[k] + 0.001 * v**2
            m, s = self.first[k] / (1 - 0.9**self.updates), self.second[k] / (1 - 0.999**self.updates)
            self.params[k] -= self.rate * (m / (np.sqrt(s) + 1e-8) + self.decay * self.params[k])
        self.losses.append(loss)
        return loss

    def learn(self, buffer: pd.DataFrame, new: int, least: int = 32, every: int = 8) -> int:
        """Steps for `new` rows at the end of `buffer` (features, true_confidence, true_routing, true_error, in order). Returns how many."""
        before, self.seen = self.seen, self.seen + new
        due = 0 if self.seen < least else (self.seen - least) // every + 1 - (0 if before < least else (before - least) // every + 1)
        if due:
            x = np.array(buffer["features"].tolist(), dtype=float)
            y = [buffer[c].to_numpy() for c in ("true_confidence", "true_routing", "true_error")]
            weight = 1 + np.arange(len(x)) / len(x)
            for _ in range(due):
                at = np.random.default_rng(self.updates).choice(len(x), self.sample, p=weight / weight.sum())
                self.step(x[at], y[0][at].astype(float), y[1][at].astype(int), y[2][at].astype(int))
        return due

    def save(self, spark, path: str) -> None:
        """Weights, optimiser and counts as a table of named numbers."""
        parts = {f"{kind}/{k}": v for kind, held in (("params", self.params), ("first", self.first), ("second", self.second)) for k, v in held.items()}
        parts["counts"] = np.array([self.updates, self.seen], dtype=float)
        rows = [(n, [int(x) for x in v.shape], [float(x) for x in v.ravel()]) for n, v in parts.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> "OnlineLearner":
        for r in spark.read.parquet(path).collect():  # one row per array of weights
            kind, _, k = r.name.partition("/")
            value = np.array(r.numbers, dtype=float).reshape(r.shape)
            if kind == "counts":
                self.updates, self.seen = int(value[0]), int(value[1])
            else:
                getattr(self, kind)[k] = value
        return self


def gradients(p: dict[str, np.ndarray], x: np.ndarray, confidence: np.ndarray, routing: np.ndarray, error: np.ndarray, clip: float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, gradients) of 2 x squared error + 1.5 x routing + 1 x error cross-entropy, the norm of the gradients clipped."""
    n = len(x)
    h, c, r, e = forward(p, x)
    one = lambda y, k: np.eye(k)[y]
    loss = 2 * ((c - confidence) ** 2).mean() - 1.5 * np.log(r[np.arange(n), routing] + 1e-12).mean() - np.log(e[np.arange(n), error] + 1e-12).mean()
    dc = (4 * (c - confidence) * c * (1 - c) / n)[:, None]
    dr, de = 1.5 * (r - one(routing, 3)) / n, (e - one(error, 5)) / n
    dh = (dc @ p["wc"].T + dr @ p["wr"].T + de @ p["we"].T) * (h > 0)
    g = {"w1": x.T @ dh, "b1": dh.sum(0), "wc": h.T @ dc, "bc": dc.sum(0), "wr": h.T @ dr, "br": dr.sum(0), "we": h.T @ de, "be": de.sum(0)}
    size = np.sqrt(sum((v**2).sum() for v in g.values()))
    return float(loss), {k: v * min(1.0, clip / (size + 1e-12)) for k, v in g.items()}


def train_step(p: dict[str, np.ndarray], x: np.ndarray, confidence: np.ndarray, routing: np.ndarray, error: np.ndarray, rate: float = 1e-2, clip: float = 1.0) -> float:
    """One plain step down the `gradients`. Returns the loss before it."""
    loss, g = gradients(p, x, confidence, routing, error, clip)
    for k in p:
        p[k] -= rate * g[k]
    return loss
