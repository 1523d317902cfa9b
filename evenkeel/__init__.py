"""Two-input data reconciliation on Spark."""

from evenkeel.config import ReconConfig
from evenkeel.errors import CompareError, ConfigError, ReconError, SourceError
from evenkeel.operators.fingerprint import hash_compare
from evenkeel.plans.compare import compare
from evenkeel.result import ReconResult
from evenkeel.sources import AvroFile, CsvFile, DataFrameSource, ExcelFile, FixedWidthFile, JdbcQuery, JsonFile, MainframeFile, OdbcQuery, OrcFile, ParquetFile, PostgresSource, Source, SqlQuery, SqlTable, XmlFile, source
from evenkeel.types import HashCompareResult, PartitionSpec

__all__ = ["AvroFile", "CompareError", "ConfigError", "CsvFile", "DataFrameSource", "ExcelFile", "FixedWidthFile", "HashCompareResult", "JdbcQuery", "JsonFile", "MainframeFile", "OdbcQuery", "OrcFile", "ParquetFile", "PartitionSpec", "PostgresSource", "ReconConfig", "ReconError", "ReconResult", "Source", "SourceError", "SqlQuery", "SqlTable", "XmlFile", "compare", "hash_compare", "source"]
__version__ = "0.1.0"
