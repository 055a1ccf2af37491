"""Which files a table of texts names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.functions.paths import base_name_first_dot
from dataroute.functions.text import quoted, unquoted


def literal_inventory(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(base, n_texts, n_literals)``: texts and literals naming each base name.

    Literals are counted per text and name before anything is shuffled, and the
    first shuffle is on both, so a name that a third of all texts use is spread
    over all tasks; the second carries one partial row per name and task.
    """
    # In two steps: the name looks at the content several times.
    contents = F.transform(quoted(text_col), unquoted)
    bases = F.transform(contents, base_name_first_dot)
    per_text = (
        df.select(
            F.col(id_col).alias("id"),
            # Misses go before the explode: a filter after it would be pushed
            # down and evaluate the names a second time.
            F.explode(F.array_compact(bases)).alias("base"),
        )
        .groupBy("base", "id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_text.groupBy("base").agg(
        F.count("id").alias("n_texts"), F.sum("n").alias("n_literals")
    )
