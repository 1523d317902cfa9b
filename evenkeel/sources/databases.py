"""Tables and queries of databases: JDBC, SQLite by Python's own module, ODBC."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

from evenkeel.errors import SourceError
from evenkeel.sources.base import Source
from evenkeel.streaming.cursors import frame_of_cursor

# JDBC subprotocols, drivers and default ports by the URL's first part.
JDBC = {
    "postgresql": ("postgresql", "org.postgresql.Driver", 5432),
    "postgres": ("postgresql", "org.postgresql.Driver", 5432),
    "redshift": ("redshift", "com.amazon.redshift.jdbc42.Driver", 5439),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver", 3306),
    "mariadb": ("mariadb", "org.mariadb.jdbc.Driver", 3306),
    "mssql": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("oracle:thin", "oracle.jdbc.OracleDriver", 1521),
    "snowflake": ("snowflake", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "bigquery": ("bigquery", "com.simba.googlebigquery.jdbc.Driver", 443),
    "databricks": ("databricks", "com.databricks.client.jdbc.Driver", 443),
    "hana": ("sap", "com.sap.db.jdbc.Driver", 30015),
    "teradata": ("teradata", "com.teradata.jdbc.TeraDriver", 1025),
}


def jdbc_options(url: str) -> dict[str, str]:
    """Spark's JDBC options for a URL like dialect+driver://user:password@host:port/database?key=value, or a jdbc: URL as it is."""
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    dialect = parts.scheme.split("+")[0].lower()
    if dialect not in JDBC:
        raise SourceError(f"no JDBC driver is known for {parts.scheme or url!r}")
    protocol, driver, port = JDBC[dialect]
    host, database = parts.hostname or "localhost", unquote(parts.path.lstrip("/"))
    query = dict(parse_qsl(parts.query, keep_blank_values=True))
    if dialect == "mssql":
        query.pop("driver", None)
        tail = "".join(f";{k}={v}" for k, v in query.items())
        address = f"jdbc:sqlserver://{host}:{parts.port or port};databaseName={database}{tail}"
    elif dialect == "oracle":
        address = f"jdbc:oracle:thin:@//{host}:{parts.port or port}/{query.get('service_name', database)}"
    elif dialect == "teradata":
        address = f"jdbc:teradata://{host}/DATABASE={database},DBS_PORT={parts.port or port}"
    else:
        address = f"jdbc:{protocol}://{host}:{parts.port or port}/{database}" + (f"?{urlencode(query)}" if query else "")
    out = {"url": address, "driver": driver}
    if parts.username:
        out["user"] = unquote(parts.username)
    if parts.password:
        out["password"] = unquote(parts.password)
    return out


def sqlite_path(url: str) -> str | None:
    for prefix in ("sqlite:///", "sqlite+pysqlite:///"):
        if url.startswith(prefix):
            return url[len(prefix) :]
    return None


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_jdbc(spark: SparkSession, options: dict[str, str], query: str, column: str | None = None, parts: int = 1) -> DataFrame:
    """A query's rows. With a column of numbers, dates or timestamps they come over so many connections, in ranges between its least and largest value."""
    reader = spark.read.format("jdbc").options(**options)
    if column and parts > 1:
        mark = "`" if options["url"].startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
        name = mark + column.replace(mark, 2 * mark) + mark
        ends = spark.read.format("jdbc").options(**options).option("query", f"SELECT min({name}) AS lo, max({name}) AS hi FROM ({query}) q").load().first()
        if ends[0] is not None:
            return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts)).load()
    return reader.option("query", query).load()


def read_sql(spark: SparkSession, conn: str, query: str, chunk_size: int, streaming: bool = True, column: str | None = None, parts: int = 1) -> DataFrame:
    path = sqlite_path(conn)
    if path is None:
        return read_jdbc(spark, jdbc_options(conn) | {"fetchsize": str(chunk_size if streaming else 0)}, query, column, parts)
    import sqlite3

    if not Path(path).exists():
        raise SourceError(f"no SQLite database at {path}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return frame_of_cursor(spark, db.execute(query), chunk_size if streaming else None)


@dataclass
class SqlTable(Source):
    conn: str
    table: str
    schema: str | None = None
    chunk_size: int = 50_000
    streaming: bool = True
    partition_column: str | None = None
    num_partitions: int = 16
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        name = f"{self.schema}.{self.table}" if self.schema else self.table
        return read_sql(spark, self.conn, f"SELECT * FROM {name}", self.chunk_size, self.streaming, self.partition_column, self.num_partitions)

    def describe(self) -> str:
        return f"SqlTable({self.table})"


@dataclass
class SqlQuery(Source):
    conn: str
    query: str
    chunk_size: int = 50_000
    streaming: bool = True
    partition_column: str | None = None
    num_partitions: int = 16
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        return read_sql(spark, self.conn, self.query, self.chunk_size, self.streaming, self.partition_column, self.num_partitions)

    def describe(self) -> str:
        return "SqlQuery"


def libpq(text: str) -> dict[str, str]:
    """The settings of a PostgreSQL URL, or of a line of key=value words with values in single quotes if need be."""
    if "://" not in text:
        out, rest = {}, text.strip()
        while rest:
            key, eq, rest = rest.partition("=")
            if not eq:
                raise SourceError(f"not a PostgreSQL connection: {text!r}")
            rest, value = rest.lstrip(), ""
            if rest.startswith("'"):
                i = 1
                while i < len(rest) and rest[i] != "'":
                    i += rest[i] == "\\"
                    value += rest[i : i + 1]
                    i += 1
                rest = rest[i + 1 :]
            else:
                value, _, rest = rest.partition(" ")
            out[key.strip()] = value
            rest = rest.lstrip()
        return out
    parts = urlsplit(text)
    if parts.scheme.split("+")[0] not in ("postgresql", "postgres"):
        raise SourceError(f"not a PostgreSQL URL: {parts.scheme}")
    pairs = [("host", parts.hostname), ("port", parts.port), ("user", parts.username), ("password", parts.password), ("dbname", parts.path.lstrip("/"))]
    return {k: unquote(str(v)) for k, v in pairs if v} | dict(parse_qsl(parts.query))


def to_libpq(text: str) -> str:
    """A PostgreSQL URL as key=value words; a line of such words stays."""
    if "://" not in text:
        return text
    safe = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if v == "" or any(c in v for c in " '\\") else v
    return " ".join(f"{k}={safe(v)}" for k, v in libpq(text).items())


@dataclass
class PostgresSource(Source):
    """A PostgreSQL table or query; filters, columns, aggregates and limits are pushed into the database."""

    conn: str
    table: str | None = None
    query: str | None = None
    schema: str = "public"
    attach_alias: str | None = None
    chunk_size: int = 50_000
    partition_column: str | None = None
    num_partitions: int = 16
    keep = True

    def __post_init__(self):
        if not (self.table or self.query):
            raise SourceError("PostgresSource needs a table or a query")

    def options(self) -> dict[str, str]:
        s = libpq(self.conn)
        rest = {k: v for k, v in s.items() if k not in ("host", "port", "user", "password", "dbname")}
        url = f"jdbc:postgresql://{s.get('host', 'localhost')}:{s.get('port', '5432')}/{s.get('dbname', '')}" + (f"?{urlencode(rest)}" if rest else "")
        return {"url": url, "driver": JDBC["postgresql"][1], "fetchsize": str(self.chunk_size)} | {k: s[k] for k in ("user", "password") if k in s}

    def load(self, spark: SparkSession) -> DataFrame:
        if self.query or self.partition_column:
            query = self.query or f"SELECT * FROM {quoted(self.schema)}.{quoted(self.table)}"
            return read_jdbc(spark, self.options(), query, self.partition_column, self.num_partitions)
        return spark.read.format("jdbc").options(**self.options()).option("dbtable", f"{quoted(self.schema)}.{quoted(self.table)}").load()

    def describe(self) -> str:
        return f"PostgresSource({self.table or 'query'})"


@dataclass
class JdbcQuery(Source):
    jdbc_url: str
    driver_class: str = ""
    driver_jar: str = ""
    query: str = ""
    user: str | None = None
    password: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    num_partitions: int = 16
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        if not self.query:
            raise SourceError("JdbcQuery needs a query")
        options = {k: v for k, v in (("user", self.user), ("password", self.password), ("driver", self.driver_class)) if v} | self.properties
        if self.driver_jar:
            if not Path(self.driver_jar).exists():
                raise SourceError(f"no driver jar at {self.driver_jar}")
            spark.sparkContext._jsc.addJar(self.driver_jar)
        return read_jdbc(spark, options | {"url": self.jdbc_url}, self.query, self.partition_column, self.num_partitions)

    def describe(self) -> str:
        return f"JdbcQuery({self.jdbc_url})"


@dataclass
class OdbcQuery(Source):
    conn_str: str
    query: str
    chunk_size: int = 50_000
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        try:
            pyodbc: Any = importlib.import_module("pyodbc")
        except ImportError as e:
            raise SourceError("OdbcQuery needs the pyodbc package") from e
        with pyodbc.connect(self.conn_str) as db:
            return frame_of_cursor(spark, db.cursor().execute(self.query), self.chunk_size)

    def describe(self) -> str:
        return "OdbcQuery"
