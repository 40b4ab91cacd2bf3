"""The registry of queries: a name, a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraspan.plans.views import view, with_views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None, *views: str):
        """Register a function of these views; sql may name any of them."""

        def add(f: Callable[..., DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
            if sql:
                # numbers with a point are decimals in SQL; ours are doubles
                self.sql[f.__name__] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", with_views(sql))
            return f

        return add
