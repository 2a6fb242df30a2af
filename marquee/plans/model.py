"""The tables that queries share, built once per call."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library, recommend, sequences, vectors
from ..sources import testdata


class Model:
    """Lazy tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.sf_dir, name)

    @cached_property
    def items(self) -> DataFrame:
        return testdata.items(self.spark, self.sf_dir)

    @cached_property
    def interactions(self) -> DataFrame:
        return testdata.interactions(self.spark, self.sf_dir)

    @cached_property
    def bulk(self) -> DataFrame:
        return testdata.bulk(self.spark, self.sf_dir)

    @cached_property
    def embeddings(self) -> DataFrame:
        return testdata.embeddings(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return testdata.users(self.spark, self.sf_dir)

    @cached_property
    def units(self) -> DataFrame:
        """All vectors of the catalog, of length 1."""
        return vectors.unit_table(self.embeddings)

    @cached_property
    def seqs(self) -> DataFrame:
        return sequences.sequences(self.interactions, self.embeddings)

    @cached_property
    def ranking(self) -> DataFrame:
        return recommend.popularity(self.interactions)

    @cached_property
    def seen(self) -> DataFrame:
        return library.seen(self.interactions)

    @cached_property
    def queries(self) -> DataFrame:
        return recommend.mean_vectors(sequences.last(self.seqs), self.units)

    @cached_property
    def candidates(self) -> DataFrame:
        return recommend.similar_for_users(self.queries, self.units, self.seen, 10)

    @cached_property
    def library(self) -> DataFrame:
        return library.library(self.interactions, self.items)

    @cached_property
    def samples(self) -> DataFrame:
        return sequences.holdout(self.seqs)


def joined(column: str):
    """An array as text, so that no engine's list format matters."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "|")
