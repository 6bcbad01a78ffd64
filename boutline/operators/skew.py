"""Joins whose big side may have one key on a third of its rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join in which every row of ``small`` stands once per salt and ``big`` rows pick a salt from their content,
    so that one key is shared by ``salts`` tasks. ``small`` should hold few rows per key; ``how`` is inner, left,
    left_semi or left_anti."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
