"""Confidence heads: models that score how likely a value is right.

Trained heads are ``pyspark.ml`` pipelines fitted on the cluster. Heads run to
convergence, so a snapshot after ``k`` steps is a fit with ``maxIter = k``;
non-linear heads use the sigmoid units of Spark's perceptron. Weights exported
from elsewhere are applied by :func:`pooled_scores`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numbers import sigmoid
from ..session import staged
from . import features, policy, review
from .bootstrap import side_by_side
from .cohorts import folds


@dataclass(frozen=True)
class Trial:
    """One point of a head grid."""

    mode: str
    inputs: tuple[str, ...]
    l2: float = 0.001
    steps: int = 100
    prior: bool = False
    seed: int = 42
    width: int = 8

    @property
    def family(self) -> str:
        return f"{self.mode}[{'+'.join(self.inputs)}]" + ("+prior" if self.prior else "")

    @property
    def name(self) -> str:
        return f"{self.family}_l2{self.l2}_steps{self.steps}_seed{self.seed}"


def grid(modes: Sequence[str], inputs: Sequence[Sequence[str]], l2: Sequence[float] = (0.001, 0.01),
         steps: Sequence[int] = (100,), prior: Sequence[bool] = (False,), seeds: Sequence[int] = (42,)) -> list[Trial]:
    """Every combination of the settings, in a fixed order."""
    unknown = [m for m in modes if m not in MODES]
    if unknown:
        raise ValueError(f"unknown head modes {unknown}; use {sorted(MODES)}")
    return [Trial(m, tuple(i), penalty, k, p, s) for s in seeds for m in modes for i in inputs for penalty in l2
            for k in steps for p in prior]


def _linear(trial: Trial, size: int) -> list:
    # Spark halves its L2 term, so twice the penalty gives the same objective.
    return [LogisticRegression(featuresCol="features", labelCol="label", regParam=2 * trial.l2, elasticNetParam=0.0,
                               maxIter=trial.steps, standardization=False)]


def _perceptron(trial: Trial, size: int) -> list:
    return [MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", maxIter=trial.steps, seed=trial.seed,
                                           layers=[size, trial.width, 2])]


#: Head mode -> stages after the scaled feature vector. Add an entry to plug in another mode.
#: ``mean`` expects a pooled input, see ``with_pooled``.
MODES: dict[str, Callable[[Trial, int], list]] = {"linear": _linear, "mlp": _perceptron, "mean": _perceptron}


def with_pooled(rows: DataFrame, width: int) -> DataFrame:
    """Rows with the input ``pooled``: the mean state of the content tokens (``tokens``, ``mask``); null without a trace."""
    return rows.withColumn("pooled", F.when(F.col("tokens").isNotNull(), features.masked_mean(F.col("tokens"), F.col("mask"), width)))


def vectors(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Adds ``label`` and one vector column ``v_<input>`` per array input (null where there is no trace)."""
    for name in inputs:
        rows = rows.withColumn(f"v_{name}", array_to_vector(F.transform(name, lambda x: x.cast("double"))))
    return rows.withColumn("label", F.col("correct").cast("double"))


def fit_head(rows: DataFrame, trial: Trial, sizes: Mapping[str, int], prior_least: int = 16) -> PipelineModel:
    """Fit one head on rows with array inputs and ``correct``; inputs are standardised on these rows only.

    ``sizes`` gives the width of every input.
    """
    stages, names = [], [f"v_{i}" for i in trial.inputs]
    stages += [VectorAssembler(inputCols=names, outputCol="raw"),
               StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)]
    parts, width = ["scaled"], sum(sizes[i] for i in trial.inputs)
    if trial.prior:
        # The indexer numbers unseen values last and the encoder drops the last number: they are the level without coefficient.
        stages += [StringIndexer(inputCol="prior_field", outputCol="prior_at", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol="prior_at", outputCol="prior_hot", handleInvalid="error", dropLast=True)]
        frequent = rows.groupBy("field_id").agg(F.count("*").alias("n")).filter(F.col("n") >= prior_least).select(
            "field_id", F.lit(True).alias("known"))
        # Fields without a prior are null here and unknown to the indexer later: both are that level, and add nothing.
        rows = rows.join(frequent, "field_id", "left").withColumn("prior_field", F.when(F.col("known"), F.col("field_id"))).drop("known")
        parts.append("prior_hot")
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), *MODES[trial.mode](trial, width)]
    return Pipeline(stages=stages).fit(vectors(rows, trial.inputs))


def head_logits(model: PipelineModel, rows: DataFrame, trial: Trial) -> DataFrame:
    """Adds the head's ``logit`` of being right."""
    ready = vectors(rows, trial.inputs)
    if trial.prior:
        ready = ready.withColumn("prior_field", F.col("field_id"))
    raw = vector_to_array("rawPrediction")
    # A perceptron reports one raw value per class, a logistic model +- the logit.
    logit = F.get(raw, F.lit(1)) - F.get(raw, F.lit(0)) if trial.mode != "linear" else F.get(raw, F.lit(1))
    return model.transform(ready).withColumn("logit", logit).select(*rows.columns, "logit")


def score_trials(train: DataFrame, dev: DataFrame, trials: Sequence[Trial], sizes: Mapping[str, int]) -> DataFrame:
    """Dev numbers of every trial: ``(trial, family, review_rate, aurc, auroc)``. One small row per trial."""
    train, dev = staged(train, "head-train"), staged(dev, "head-dev")
    reports = []
    for trial in trials:
        scored = head_logits(fit_head(train, trial, sizes), dev, trial).withColumn("score", sigmoid(F.col("logit")))
        reports.append(ranked_row(staged(scored.drop(*trial.inputs), "head-scores"), trial.name, trial.family))
    result = reports[0]
    for more in reports[1:]:
        result = result.unionByName(more)
    return result


def ranked_row(scored: DataFrame, trial: str, family: str) -> DataFrame:
    """The numbers heads are ranked by, for one scored cohort."""
    evaluation = review.evaluate_policy(scored, policy.fit_policy(scored)).select("review_rate", "error_recall")
    return side_by_side(evaluation, review.aurc(scored).select("aurc"), review.auroc(scored).select("auroc")).select(
        F.lit(trial).alias("trial"), F.lit(family).alias("family"), "*")


def family_winners(trials: DataFrame) -> DataFrame:
    """Best trial of each family and the best family (``primary``): review rate, then AURC, then AUROC, then name.

    The input has one row per trial, a few hundred at most.
    """
    order = (F.asc("review_rate"), F.asc("aurc"), F.desc(F.coalesce("auroc", F.lit(0.0))), F.asc("trial"))
    best = trials.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(*order))).filter("r = 1").drop("r")
    return best.withColumn("primary", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) == 1)


def out_of_fold(rows: DataFrame, inputs: Sequence[str], sizes: Mapping[str, int], l2: float = 0.001, count: int = 5,
                seed: int = 0) -> DataFrame:
    """Out-of-fold logits of a logistic model; folds never split a document and each fold is scaled on its own training rows."""
    dealt = staged(folds(rows, count, seed), "folds")
    trial, parts = Trial("linear", tuple(inputs), l2, 200), []
    for fold in range(count):
        model = fit_head(dealt.filter(F.col("fold") != fold), trial, sizes)
        parts.append(head_logits(model, dealt.filter(F.col("fold") == fold), trial))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def probe(rows: DataFrame, sets: Mapping[str, Sequence[str]], sizes: Mapping[str, int],
          penalties: Sequence[float] = (0.001, 0.01), count: int = 5) -> DataFrame:
    """Per feature set and penalty: AUROC, Brier score and review rate of out-of-fold logits, the best penalty marked."""
    lines = []
    for name, inputs in sets.items():
        for l2 in penalties:
            scored = out_of_fold(rows, inputs, sizes, l2, count).withColumn("score", sigmoid(F.col("logit")))
            scored = staged(scored.drop(*inputs), "probe")
            line = side_by_side(ranked_row(scored, f"l2={l2}", name), review.accuracy_brier_nll(scored).select("brier"))
            lines.append(line.withColumn("penalty", F.lit(l2)))
    result = lines[0]
    for more in lines[1:]:
        result = result.unionByName(more)
    order = Window.partitionBy("family").orderBy(F.desc("auroc"), "penalty")
    return result.withColumn("best", F.row_number().over(order) == 1)


# ------------------------------------------------------------------ exported heads

@dataclass(frozen=True)
class PooledWeights:
    """Weights of a pooling head: token projection, pooling direction or mean, output layer."""

    project: np.ndarray
    attention: np.ndarray | None
    output: np.ndarray
    bias: float = 0.0


def pooled_scores(tokens: Column, mask: Column, weights: PooledWeights) -> Column:
    """Logit of every record from its token states: project, tanh, pool over content tokens, output layer.

    Args:
        tokens: ``array<double>``, the token states one after the other.
        mask: ``array<boolean>``, which tokens carry content.
        weights: Of fixed size whatever the data; sent along with the function.

    With an attention direction the pool is its softmax over the content
    tokens, otherwise their mean. The algebra of a record stays in its row.
    """
    width = weights.project.shape[0]

    def batch(tokens: pd.Series, mask: pd.Series) -> pd.Series:
        def one(states, content) -> float:
            hidden = np.tanh(np.asarray(states, dtype=float).reshape(-1, width) @ weights.project)
            keep = np.asarray(content, dtype=bool)
            if weights.attention is None:
                share = keep / max(keep.sum(), 1)
            else:
                level = np.where(keep, hidden @ weights.attention, -np.inf)
                share = np.exp(level - level.max())
                share /= share.sum()
            return float(share @ hidden @ weights.output + weights.bias)

        return pd.Series([one(t, m) for t, m in zip(tokens, mask, strict=True)])

    return F.pandas_udf(batch, DoubleType())(tokens, mask)
