"""Step 2: parameters to new samples, one kernel density per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kde import fit_kde
from ..operators.sampling import sample_table
from ..schema import DRAWS_PER_CLASS, SEED


def usable_params(params: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Rows with status ok, of the named classes (default: all)."""
    ok = params.where("status = 'ok'")
    return ok if classes is None else ok.where(F.col("class").isin(list(classes)))


def classes_in_order(params: DataFrame) -> DataFrame:
    """Classes of the usable rows with the place where each first occurs."""
    return usable_params(params).groupBy("class").agg(F.min("input_ordinal").alias("first_seen"))


def sample_params(params: DataFrame, n: int = DRAWS_PER_CLASS, seed: int = SEED,
                  classes: list[str] | None = None) -> DataFrame:
    """n new parameter vectors per class. Classes that cannot be fitted (fewer than two rows,
    no variation) are left out; when none is left this raises."""
    rows = usable_params(params, classes)
    model = fit_kde(rows)
    if model.isEmpty():
        raise ValueError("no class has two or more distinct usable parameter rows")
    return sample_table(rows, model, n, seed)
