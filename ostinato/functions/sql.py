"""The scalar functions under SQL names: temporary SQL functions, which the optimiser expands into plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ostinato.functions.music import BLACK, PITCH_CLASSES

_NAMES = ", ".join(f"'{p}'" for p in PITCH_CLASSES)
FUNCTIONS = {
    "pitch_name(p BIGINT) RETURNS STRING": f"concat(element_at(array({_NAMES}), cast(pmod(p, 12) + 1 as int)), cast(floor(p / 12) - 1 as string))",
    "is_black_key(p BIGINT) RETURNS BOOLEAN": f"pmod(p, 12) in ({', '.join(map(str, BLACK))})",
    "pitch_hz(p BIGINT) RETURNS DOUBLE": "440D * power(2D, (p - 69) / 12D)",
    "snap_to_grid(x DOUBLE, step DOUBLE, phase DOUBLE) RETURNS DOUBLE": "rint((x - phase) / step) * step + phase",
    "floor_mod(x DOUBLE, m DOUBLE) RETURNS DOUBLE": "x - floor(x / m) * m",
    "f1_score(p DOUBLE, r DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(2 * p * r, p + r), 0D)",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
