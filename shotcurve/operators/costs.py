"""Prices and costs of recorded usage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.metrics import economy_score, total_cost
from shotcurve.operators.joins import join_one

USAGE = ["input_tokens", "output_tokens", "latency_ms"]


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, i, o) for m, (i, o) in fv.PRICES.items()]
    return spark.createDataFrame(rows, "model_name string, input_price double, output_price double")


def price_usage(df: DataFrame, prices: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Attach input_price and output_price by model; unlisted models cost 0.

    Rows with negative usage stay, with usage_error naming the first such column
    and NULL prices, so that their cost is NULL; when strict they fail the job.
    The built-in price list is a fixed short list, so it becomes an expression;
    a caller's list is joined, of several prices of a model the lowest; when strict
    different ones fail the job."""
    error = F.coalesce(*[F.when(F.col(c) < 0, F.lit(f"{c} must be non-negative")) for c in USAGE])
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    df = df.withColumn("usage_error", error)
    if prices is not None:
        listed = prices.select("model_name", "input_price", "output_price")
        order = [F.col("input_price"), F.col("output_price")]
        return join_one(df, listed, ["model_name"], order, "the price list" if strict else None).withColumns({
            c: F.when(F.col("usage_error").isNull(), F.coalesce(c, F.lit(0.0)))
            for c in ("input_price", "output_price")})
    model_in, model_out = F, F
    for model, (price_in, price_out) in fv.PRICES.items():
        model_in = model_in.when(F.col("model_name") == model, F.lit(price_in))
        model_out = model_out.when(F.col("model_name") == model, F.lit(price_out))
    return df.withColumns({
        c: F.when(F.col("usage_error").isNull(), price.otherwise(F.lit(0.0)))
        for c, price in (("input_price", model_in), ("output_price", model_out))})


def with_cost(priced: DataFrame, accuracy: str = "score", time_price: float = 0.0) -> DataFrame:
    """Add total_cost and economy_score to priced rows; both are NULL without prices."""
    return (
        priced.withColumn("total_cost", total_cost(time_price=time_price))
        .withColumn("economy_score", F.when(
            F.col("total_cost").isNotNull(), economy_score(accuracy, "total_cost"))))
