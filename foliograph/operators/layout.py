"""Lines, pages and paragraphs of a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(T.lines(F.col(text_col))).alias("line_no", "line"))


def near_equal_pages(lines: Column, pages: int) -> Column:
    """Lines cut into pages of near equal length; bounds are rounded half to even."""
    n = F.size(lines)
    bound = [F.bround(F.lit(k) * n / F.lit(pages)).cast("int") for k in range(pages + 1)]
    return F.array(*[F.slice(lines, bound[k] + 1, F.greatest(bound[k + 1] - bound[k], F.lit(0))) for k in range(pages)])


def collapse_pages(text: Column) -> Column:
    """Form feeds become blank lines, runs of blank lines one; (text, n_lines, n_pages)."""
    pages = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1
    flat = F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n\n")), r"[ \t]+\n", "\n")
    flat = F.trim(F.regexp_replace(flat, r"\n{3,}", "\n\n"), F.lit(" \n"))
    filled = F.size(F.filter(F.split(flat, "\n"), lambda s: F.trim(s) != ""))
    return F.struct(flat.alias("text"), filled.alias("n_lines"), pages.alias("n_pages"))


def byte_budget(lines: DataFrame, id_col: str, most: int) -> DataFrame:
    """Lines of each text while those before take fewer than ``most`` bytes."""
    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(id_col).orderBy("line_no")) - F.octet_length("line") - 1
    return lines.withColumn("before", before).where(F.col("before") < most).drop("before")


def paragraphs(df: DataFrame, id_col: str, text_col: str, size: int = 1200, least: int = 80, most: int = 1600) -> DataFrame:
    """(id, paragraph, text): lines joined until a blank line, a heading or ``size`` characters; short ones are left out.

    The greedy cut is sequential within a text, so each text is cut whole by an Arrow function.
    """

    def cut(batches):
        for pdf in batches:
            out = []
            for key, text, heads in zip(pdf["id"], pdf["lines"], pdf["heads"]):
                found, now = [], []

                def flush():
                    joined = " ".join(now).strip()
                    if len(joined) >= least:
                        found.append(joined[:most])
                    now.clear()

                for line, head in zip(text, heads):
                    if not line or head:
                        flush()
                    if line:
                        now.append(line)
                        if head or sum(map(len, now)) + len(now) - 1 >= size:
                            flush()
                flush()
                out += [(key, i, t) for i, t in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "paragraph", "text"]).astype({"paragraph": np.int32})

    lines = F.transform(T.lines(F.col(text_col)), T.collapse)
    ready = df.select(F.col(id_col).alias("id"), lines.alias("lines")).withColumn("heads", F.transform("lines", T.heading))
    return ready.mapInPandas(cut, "id long, paragraph int, text string")
