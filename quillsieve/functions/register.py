"""SQL names: scalar functions over Arrow batches, and a table function of a text's lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

from ..operators import formats, textops


@F.udtf(returnType="ln int, line string, kind string")
class CondenseLines:
    """Lines of a condensed text: ``signal``, ``mark`` or ``plain``."""

    def eval(self, text: str):
        out = textops.condense(text or "", textops.Options(no_sidecar=True), "", formats.first_match)["out"]
        for k, line in enumerate((out or "").split("\n")):
            yield k, line, "mark" if line.startswith("[trim hook:") else "signal" if textops.is_signal(line) else "plain"


def register(spark: SparkSession) -> None:
    """Register ``clean_text``, ``condense_text``, ``is_signal``, ``token_estimate``, ``token_class``, ``fnv1a`` and ``condense_lines``."""

    def scalar(f, kind):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x))

        return F.pandas_udf(run, kind)

    spark.udf.register("clean_text", scalar(textops.clean, StringType()))
    spark.udf.register("condense_text", scalar(lambda t: textops.condense(t, textops.Options(no_sidecar=True), "", formats.first_match)["out"], StringType()))
    spark.udf.register("is_signal", scalar(textops.is_signal, BooleanType()))
    spark.udf.register("token_estimate", scalar(lambda t: textops.token_estimate(t)[0], LongType()))
    spark.udf.register("token_class", scalar(textops.token_class, StringType()))
    spark.udf.register("fnv1a", scalar(textops.fnv1a, StringType()))
    spark.udtf.register("condense_lines", CondenseLines)
