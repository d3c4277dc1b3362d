"""Tables of the queries, and the views over them that operators and their SQL share.

A view is plain SQL that Spark and DuckDB both run, with tables in braces; ``view`` runs it in Spark, ``inline`` gives
it to DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Cards from parts: prints with names of several families, zero-padded local ids, blank and unknown rarities.
CARDS = """SELECT p_partkey AS id, p_partkey AS pos, p_size AS species, p_brand AS set_id, p_retailprice AS price,
  CASE p_partkey % 11 WHEN 0 THEN 'Mega ' || p_name || ' X ex' WHEN 1 THEN 'Mega ' || p_name || '-ex' WHEN 2 THEN p_name || ' VMAX'
    WHEN 3 THEN 'M ' || p_name || '-EX' WHEN 4 THEN 'Mega ' || p_name || ' & old bolt GX' WHEN 5 THEN p_name || 'Yex' ELSE p_name END AS name,
  lpad(CAST(p_partkey % 60 AS STRING), 3, '0') AS local_id,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Unknown' ELSE p_type END AS rarity,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE 'img/' || CAST(p_partkey AS STRING) END AS image
FROM {part}"""
#: A second source of the same prints: every other part, other spellings.
SOURCE = """SELECT p_partkey * 10 AS source_id, p_partkey AS pos, p_brand AS set_id, lpad(CAST(p_partkey % 60 AS STRING), 2, '0') AS local_id,
  p_size AS species, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, 'src/' || CAST(p_partkey AS STRING) AS image, p_type AS rarity
FROM {part} WHERE p_partkey % 2 = 0"""
#: Ownership: one row for each customer and part size of its orders.
OWNED = """SELECT o_custkey AS owner, p_size AS species, min(l_partkey) AS card_id, min(o_orderdate) AS since
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_custkey, p_size"""
VIEWS = {"cards": CARDS, "source": SOURCE, "owned": OWNED}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    return sql(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over tables and views in braces."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def inline(text: str) -> str:
    """The same SQL for DuckDB: views as subqueries, tables by name."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({inline(VIEWS[m[1]])})" if m[1] in VIEWS else m[1], text)


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of ``t`` (name to DataFrame) as a query, with SQL (views in braces) to hold it against."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: sql(spark, sf_dir, n) if " " in n else table(spark, sf_dir, n))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = inline(oracle)
        return f

    return register
