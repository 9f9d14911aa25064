"""Expression-free blueprints from labelled voxels, and PCA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.axis import z_index


def _world(affine: Sequence[Sequence[float]], row: int) -> Column:
    a = affine[row]
    return a[0] * F.col("i") + a[1] * F.col("j") + a[2] * F.col("k") + F.lit(float(a[3]))


def extract_blueprint(voxels: DataFrame, affine: Sequence[Sequence[float]], schema: DataFrame, by: Sequence[str] = ("age",), prefix: str = "voxel") -> DataFrame:
    """Included voxels as spots with world coordinates, a stable id and a z order.

    ``voxels`` (by…, i, j, k, region_id) · ``schema`` (region_id, region_label,
    include).  A region id outside the schema fails.  z is one plane value, that
    of the plane's first included voxel in (i, k) order.
    """
    known = voxels.join(schema.withColumn("_known", F.lit(True)), "region_id", "left")
    ok = F.when(F.col("_known"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("region id absent from schema: "), F.col("region_id").cast("string"))).cast("boolean")
    )
    kept = known.where(ok & F.col("include") & (F.col("region_id") != 0))
    planes = kept.groupBy(*by, "j").agg(F.min(F.struct("i", "k")).alias("_f")).select(
        *by, "j", F.col("_f.i").alias("i"), F.col("_f.k").alias("k")
    ).withColumn("z_world", F.round(_world(affine, 2), 2))
    ordered = z_index(planes.select(*by, "j", "z_world"), "z_world", by)
    token = F.regexp_replace(F.lower(F.col(by[0])), r"\.", "_")
    spot = F.format_string(
        prefix + "-%s-z%03d-j%03d-i%03d-k%03d", token, F.col("z_index"), F.col("j"), F.col("i"), F.col("k")
    )
    return kept.join(ordered, [*by, "j"]).select(
        *by, spot.alias("spot_id"), "z_index", "z_world", "i", "j", "k", _world(affine, 0).alias("x"),
        _world(affine, 1).alias("y"), F.col("region_label").alias("region"),
    )


def volume_summary(blueprint: DataFrame, by: Sequence[str] = ("age",)) -> DataFrame:
    """Spots per z level."""
    return blueprint.groupBy(*by, "z_index", "z_world").agg(F.count(F.lit(1)).alias("n_spots"))


def pca(df: DataFrame, vec: str, k: int, id_col: str = "obs_id") -> tuple[DataFrame, list[float]]:
    """Scores on the first k components of the centred array column, and explained shares.

    Only the dims × dims covariance reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tallyscope.operators.transform import center

    rows = center(df.select(id_col, vec), vec).withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    scores = model.transform(rows).select(id_col, vector_to_array("_p").alias("pc"))
    return scores, [float(x) for x in model.explainedVariance]
