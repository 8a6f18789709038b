"""Database urls as options of the JDBC source."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

DRIVERS = {"postgres": ("postgresql", "org.postgresql.Driver"), "postgresql": ("postgresql", "org.postgresql.Driver"), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"), "sqlite": ("sqlite", "org.sqlite.JDBC")}


def jdbc_options(url: str, require_ssl: bool = False) -> dict[str, str]:
    """JDBC options of ``scheme://user:password@host:port/name?options``; other schemes are an error."""
    p = urlparse(url)
    if p.scheme not in DRIVERS:
        raise ValueError(f"unsupported database scheme {p.scheme!r}")
    name, driver = DRIVERS[p.scheme]
    if name == "sqlite":
        return {"url": f"jdbc:sqlite:{unquote(p.path[1:]) or ':memory:'}", "driver": driver}
    out = {"url": f"jdbc:{name}://{p.hostname or 'localhost'}" + (f":{p.port}" if p.port else "") + f"/{unquote(p.path.lstrip('/'))}", "driver": driver}
    if p.username:
        out["user"] = unquote(p.username)
    if p.password:
        out["password"] = unquote(p.password)
    if require_ssl and name == "postgresql":
        out["sslmode"] = "require"
    return out | dict(parse_qsl(p.query))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url), dbtable=table, **options).load()
