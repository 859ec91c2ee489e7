"""trendlens: trending-video analytics as Spark DataFrame operators.

Entry points: ``trendlens.session.get_spark``, ``trendlens.plans.etl.build_tables``
(CSV export -> saved clean and tag tables), ``trendlens.operators`` (the query
operators), ``trendlens.api.TrendingData`` (one method per question of the
original endpoints) and ``trendlens.streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
