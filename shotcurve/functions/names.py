"""Small column helpers: model names, providers, shot counts, keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.text import as_column


def short_model_name(c) -> Column:
    """Text after the last slash."""
    return F.substring_index(as_column(c), "/", -1)


def provider(c) -> Column:
    """Provider by model-name prefix."""
    c = as_column(c)
    chain = F
    for prefix, name in fv.PROVIDER_PREFIXES:
        chain = chain.when(c.startswith(prefix), F.lit(name))
    return chain.otherwise(F.lit(fv.DEFAULT_PROVIDER))


def api_model_name(c) -> Column:
    """Name to send to the provider: the local prefix removed."""
    return F.regexp_replace(as_column(c), f"^{fv.LOCAL_PREFIX}", "")


def resolve_shot_count(c) -> Column:
    """Nearest scheduled shot count, the smaller one on ties."""
    c = as_column(c)
    options = [F.struct(F.abs(c - s).alias("distance"), F.lit(s).alias("shot")) for s in fv.SHOTS]
    return F.when(c.isNotNull(), F.array_min(F.array(*options))["shot"])


def input_sha256(c) -> Column:
    return F.sha2(as_column(c), 256)
