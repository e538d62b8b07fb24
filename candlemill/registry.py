"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.assessment_queries import QUERIES as ASSESSMENT_QUERIES
from .plans.assessment_sql import SQL as ASSESSMENT_SQL
from .plans.bar_queries import QUERIES, feats
from .plans.bar_sql import SQL
from .plans.report_queries import QUERIES as REPORT_QUERIES
from .plans.report_sql import SQL as REPORT_SQL
from .plans.signal_queries import QUERIES as SIGNAL_QUERIES
from .plans.signal_sql import SQL as SIGNAL_SQL
from .plans.source_queries import QUERIES as SOURCE_QUERIES
from .plans.source_sql import SQL as SOURCE_SQL
from .plans.trend_queries import QUERIES as TREND_QUERIES
from .plans.trend_sql import SQL as TREND_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with all their features."""
    return feats(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | ASSESSMENT_QUERIES | REPORT_QUERIES | TREND_QUERIES | SIGNAL_QUERIES | SOURCE_QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | ASSESSMENT_SQL | REPORT_SQL | TREND_SQL | SIGNAL_SQL | SOURCE_SQL
