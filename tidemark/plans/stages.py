"""Triage as ``pyspark.ml`` stages: parameters, one ``Pipeline``, one saved model.

Rows need ``narrative``; rows to fit on also need ``label``. Every stage adds columns in place and keeps all rows, so
a fitted pipeline also runs on a stream.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.domain import with_domain_gate
from tidemark.functions.routing import with_routing
from tidemark.functions.severity import with_severity
from tidemark.functions.sub_issue import with_sub_issue
from tidemark.functions.text import with_clean_text
from tidemark.operators.classify import TextClassifier
from tidemark.plans.triage import reject_out_of_domain
from tidemark.session import stored


class _Rule(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A step without fitted state; its parameters are all that is saved."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)


class _HasCategoryCol(Params):
    categoryCol = Param(Params._dummy(), "categoryCol", "column of the category", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(categoryCol="category")


class DomainGate(_Rule, HasInputCol):
    """Adds whether the raw narrative belongs to the domain, with score, reason and guidance."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_domain_gate(df, self.getOrDefault("inputCol"))


class TextCleaner(_Rule, HasInputCol, HasOutputCol):
    """Adds the cleaned text."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_clean_text(df, self.getOrDefault("inputCol"), self.getOrDefault("outputCol"))


class SubIssueTagger(_Rule, HasInputCol, _HasCategoryCol):
    """Adds the sub-issue of a cleaned text within its category."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_sub_issue(df, self.getOrDefault("inputCol"), self.getOrDefault("categoryCol"))


class SeverityScorer(_Rule, HasInputCol):
    """Adds risk score, tier and signals of a cleaned text."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_severity(df, self.getOrDefault("inputCol"))


class Router(_Rule, _HasCategoryCol):
    """Adds queue, deadline, priority and actions; rows outside the domain get the rejection record."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = with_routing(df, self.getOrDefault("categoryCol"))
        return reject_out_of_domain(out) if "in_domain" in out.columns else out


class _ClassifierParams(HasInputCol, HasLabelCol, _HasCategoryCol):
    kind = Param(Params._dummy(), "kind", "baseline or improved", TypeConverters.toString)
    splitCol = Param(Params._dummy(), "splitCol", "column that names train and validation rows; empty: train on all",
                     TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(kind="improved", splitCol="", labelCol="label")


class ComplaintClassifier(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the text classifier; with ``splitCol`` the validation rows calibrate it."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _fit(self, df: DataFrame) -> "ComplaintClassifierModel":
        text, label, split = (self.getOrDefault(p) for p in ("inputCol", "labelCol", "splitCol"))
        rows = df.filter(F.col(split).isin("train", "validation")) if split else df
        # The fit passes over its rows several times; the stages before it should not run again each time.
        rows = stored(rows.select(*dict.fromkeys(c for c in (text, label, split) if c)), "classifier-rows")
        train = rows.filter(F.col(split) == "train") if split else rows
        fitted = TextClassifier.fit(train, text, label, self.getOrDefault("kind"))
        if split:
            fitted.calibrate(rows.filter(F.col(split) == "validation"), text, label)
        return self._copyValues(ComplaintClassifierModel(fitted))


class ComplaintClassifierModel(Model, _ClassifierParams, MLWritable, MLReadable):
    """Adds category, confidence, probabilities and whether the classifier is uncertain."""

    def __init__(self, fitted: TextClassifier | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        category = self.getOrDefault("categoryCol")
        out = self.fitted.predict(df.drop(category), self.getOrDefault("inputCol"))
        return out.withColumnRenamed("prediction", category)

    def write(self) -> MLWriter:
        return _ClassifierWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ClassifierReader()


class _ClassifierWriter(MLWriter):
    def __init__(self, model: ComplaintClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.save(f"{path}/fitted")


class _ClassifierReader(MLReader):
    def load(self, path: str) -> ComplaintClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ComplaintClassifierModel(TextClassifier.load(SparkSession.active(), f"{path}/fitted"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def triage_pipeline(split: str = "split", kind: str = "improved") -> Pipeline:
    """Gate, cleaning, classifier, sub-issue, severity and routing as one estimator."""
    return Pipeline(stages=[
        DomainGate(inputCol="narrative"),
        TextCleaner(inputCol="narrative", outputCol="cleaned"),
        # The classifier and the scorer clean what they are given, as in the full job.
        TextCleaner(inputCol="cleaned", outputCol="cleaned_again"),
        ComplaintClassifier(inputCol="cleaned_again", splitCol=split, kind=kind),
        SubIssueTagger(inputCol="cleaned"),
        SeverityScorer(inputCol="cleaned_again"),
        Router(),
    ])
