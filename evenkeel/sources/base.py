"""What a source is."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from evenkeel.errors import ReconError, SourceError


class Source(ABC):
    """Something that can be read as a DataFrame. Subclasses give load(); keep says whether a comparison should store what was read, as for sources that are dear to read twice."""

    keep = False

    @abstractmethod
    def load(self, spark: SparkSession) -> DataFrame: ...

    def describe(self) -> str:
        return f"{type(self).__name__}({getattr(self, 'path', '')})"

    def open(self, spark: SparkSession) -> DataFrame:
        """load() with its schema settled now, so that what cannot be read fails here."""
        try:
            df = self.load(spark)
            df.schema  # noqa: B018
        except ReconError:
            raise
        except Exception as e:
            raise SourceError(f"cannot read {self.describe()}: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}") from e
        if self.keep:
            self._kept = df = df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    def close(self) -> None:
        kept = self.__dict__.pop("_kept", None)
        if kept is not None:
            kept.unpersist()


@dataclass
class DataFrameSource(Source):
    df: DataFrame

    def load(self, spark: SparkSession) -> DataFrame:
        if not isinstance(self.df, DataFrame):
            raise SourceError(f"neither a source nor a DataFrame: {type(self.df).__name__}")
        return self.df

    def describe(self) -> str:
        return "DataFrame"


def spark_path(path: str) -> str:
    """A path under the scheme that Hadoop's connectors have for it."""
    for short, long in (("s3://", "s3a://"), ("gcs://", "gs://"), ("azure://", "abfss://"), ("az://", "abfss://")):
        if path.startswith(short):
            return long + path[len(short) :]
    return path
