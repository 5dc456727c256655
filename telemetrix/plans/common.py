"""Helpers shared by the registered plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` places (DOUBLE), the comparison convention."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_phase_case(ias: str, alt: str, cruise_ias, cruise_alt, taxi_ias, taxi_alt) -> str:
    return (f"CASE WHEN {ias} > {cruise_ias} AND {alt} > {cruise_alt} THEN 'cruise' "
            f"WHEN {ias} < {taxi_ias} AND {alt} < {taxi_alt} THEN 'taxi' "
            f"WHEN {ias} >= {taxi_ias} AND {alt} <= {cruise_alt} THEN 'takeoff' ELSE 'descent' END")


PHASE_VALUES_SQL = ("(SELECT * FROM (VALUES ('taxi', 0, 0.5), ('takeoff', 1, 1.0), ('cruise', 2, 2.0), "
                    "('descent', 3, 1.0)) AS p(phase, phase_ord, weight))")
