"""Columns by their exact names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str, of: str | None = None) -> Column:
    """The column with this name, whatever characters it has; of is a DataFrame alias."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def one_key(keys: str | list[str] | tuple[str, ...] | None) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])
