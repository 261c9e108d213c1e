"""laglake: Spark-native preparation, windowing, linear fitting and scoring of many time series.

Every operator is a function from DataFrame(s) to DataFrame expressed with the public
DataFrame / SQL API, so Catalyst plans it and the work runs partitioned on executors.
"""

from laglake.spec import DatasetSpec, StripTime, WindowSpec

__all__ = ["DatasetSpec", "StripTime", "WindowSpec"]
__version__ = "0.1.0"
