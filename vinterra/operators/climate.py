"""Station-year climate table.

The reference only fixes the column contract of its yearly weather files; the
formulas below are ours.  One grouped aggregate over the daily observations:
partial aggregation runs map-side, so the shuffle carries one small buffer per
station-year and task, whatever the number of observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col

# --- our documented choices ---------------------------------------------------
GDD_BASE = 10.0          # growing degree days: sum of max(t - 10, 0) over April-October
HOT_DAY_MIN = 35.0       # hot day: t >= 35 in June-August
RAINY_DAY_MIN = 0.05     # rainy day: rain >= 0.05 in June-August
FROST_DAY_MAX = 5.0      # frost day: t < 5 in April
CLIMATE_COLUMNS = (
    "GDD", "TM_summer", "TX_summer", "temp_amp_summer", "hot_days", "rainy_days_summer",
    "rain_June", "rain_SepOct", "frost_days_Apr", "avg_TM_Apr",
)
# ---------------------------------------------------------------------------------


def station_year_climate(obs: DataFrame, station: str, day: str, temp: str, rain: str) -> DataFrame:
    """Daily observations -> one row per (station, year) with the climate columns."""
    t, r = as_col(temp).cast("double"), as_col(rain).cast("double")
    month = F.month(day)
    summer = month.between(6, 8)
    grouped = obs.groupBy(F.col(station).alias("station_key"), F.year(day).alias("year"))
    agg = grouped.agg(
        F.sum(F.when(month.between(4, 10), F.greatest(t - F.lit(GDD_BASE), F.lit(0.0)))).alias("GDD"),
        F.avg(F.when(summer, t)).alias("TM_summer"),
        F.max(F.when(summer, t)).alias("TX_summer"),
        F.count_if(summer & (t >= F.lit(HOT_DAY_MIN))).alias("hot_days"),
        F.count_if(summer & (r >= F.lit(RAINY_DAY_MIN))).alias("rainy_days_summer"),
        F.sum(F.when(month == 6, r)).alias("rain_June"),
        F.sum(F.when(month.between(9, 10), r)).alias("rain_SepOct"),
        F.count_if((month == 4) & (t < F.lit(FROST_DAY_MAX))).alias("frost_days_Apr"),
        F.avg(F.when(month == 4, t)).alias("avg_TM_Apr"),
    )
    return agg.withColumn("temp_amp_summer", F.col("TX_summer") - F.col("TM_summer"))
