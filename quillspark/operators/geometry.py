"""Text boxes on pages: containment, columns, lines and segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = ["x", "y", "width", "height"]


def contained(blocks: DataFrame, regions: DataFrame, keys: list[str], block: str, region: str, share: float = 0.95) -> DataFrame:
    """Pairs (keys, block, region) where at least a share of the block's area lies in the region of the same page."""
    b = blocks.select(*keys, block, *(F.col(c).alias(f"b_{c}") for c in BOX))
    r = regions.select(*keys, region, *(F.col(c).alias(f"r_{c}") for c in BOX))
    side = lambda c, w: F.greatest(F.lit(0.0), F.least(F.col(f"b_{c}") + F.col(f"b_{w}"), F.col(f"r_{c}") + F.col(f"r_{w}")) - F.greatest(f"b_{c}", f"r_{c}"))
    area = F.col("b_width") * F.col("b_height")
    return b.join(r, keys).where((area > 0) & (side("x", "width") * side("y", "height") >= share * area)).select(*keys, block, region)


def column_of(boxes: DataFrame, columns: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Rows (keys, block, column_no): how many column boundaries (x - 0.75 heights) of the page a box begins at or after."""
    c = columns.select(*keys, (F.col("x") - 0.75 * F.col("height")).alias("_edge"))
    per_page = c.groupBy(*keys).agg(F.array_sort(F.collect_list("_edge")).alias("_edges"))  # a page has few columns
    count = F.size(F.filter("_edges", lambda e: e <= F.col("x")))
    return boxes.join(per_page, keys, "left").select(*keys, block, F.coalesce(count, F.lit(0)).alias("column_no"))


def line_groups(boxes: DataFrame, doc: str, page: str, block: str) -> DataFrame:
    """Rows (doc, page, block, line_no): boxes in the order of their centre and x join one of the last three lines whose
    centre is within 0.55 of the smaller height, else they begin a line. A page is one group; pages are small."""
    schema = ", ".join(f"{c} {t}" for c, t in boxes.select(doc, page, block).dtypes) + ", line_no int"

    def group(pages: pd.DataFrame) -> pd.DataFrame:
        rows = pages.assign(_c=pages.y + pages.height / 2).sort_values(["_c", "x", block], kind="stable")
        lines: list[tuple[float, float]] = []
        numbers = []
        for c, h in zip(rows._c, rows.height, strict=True):
            for n in range(len(lines) - 1, max(-1, len(lines) - 4), -1):
                if abs(c - lines[n][0]) <= 0.55 * min(h, lines[n][1]):
                    numbers.append(n + 1)
                    break
            else:
                lines.append((c, h))
                numbers.append(len(lines))
        return rows.assign(line_no=numbers)[[doc, page, block, "line_no"]]

    return boxes.groupBy(doc, page).applyInPandas(group, schema)


def segments(boxes: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Rows (keys, block, segment_no): along a line a new segment begins at a gap of at least 1.5 heights. keys name one line."""
    w = Window.partitionBy(*keys).orderBy("x", block)
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    rows = boxes.withColumn("_new", (F.coalesce(gap, F.lit(0.0)) >= 1.5 * F.col("height")).cast("int"))
    return rows.select(*keys, block, (F.sum("_new").over(w) + 1).alias("segment_no"))


def rotated(df: DataFrame, degrees: int) -> DataFrame:
    """Boxes in the unit square turned by 0, 90, 180 or 270 degrees."""
    x, y, w, h = (F.col(c) for c in BOX)
    turned = {0: (x, y, w, h), 90: (1 - y - h, x, h, w), 180: (1 - x - w, 1 - y - h, w, h), 270: (y, 1 - x - w, h, w)}[degrees % 360]
    return df.withColumns(dict(zip(BOX, turned, strict=True)))


def uncovered(blocks: DataFrame, regions: DataFrame, keys: list[str], block: str, region: str, share: float = 0.95) -> DataFrame:
    """Blocks of which no region of the same page covers a share; blocks on pages without regions too."""
    covered = contained(blocks, regions, keys, block, region, share).select(*keys, block).distinct()
    return blocks.join(covered, [*keys, block], "left_anti")


def nearest_pairs(bands: DataFrame, results: DataFrame, keys: list[str], line: str, band: str, result: str, reach: int = 4) -> DataFrame:
    """Pairs (keys, band, result, lines) where each is the other's one nearest within so many lines; ties pair nothing.

    A band meets only the results of the lines around it: both sides are joined on the page and the line.
    """
    near = F.explode(F.sequence(F.col(line) - reach, F.col(line) + reach))
    a = bands.select(*keys, band, F.col(line).alias("_a"), near.alias("_line"))
    pairs = a.join(results.select(*keys, result, F.col(line).alias("_line")), [*keys, "_line"]).withColumn("lines", F.abs(F.col("_line") - F.col("_a")))
    best = lambda one: pairs.groupBy(*keys, one).agg(F.min("lines").alias("lines"))
    only = lambda one: pairs.join(best(one), [*keys, one, "lines"]).groupBy(*keys, one).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    mutual = pairs.join(best(band), [*keys, band, "lines"]).join(best(result), [*keys, result, "lines"])
    return mutual.join(only(band), [*keys, band], "left_semi").join(only(result), [*keys, result], "left_semi").select(*keys, band, result, "lines")


def bound_issues(issues: DataFrame, rows: DataFrame, keys: list[str], issue: str, row: str, tolerance: float = 0.5) -> DataFrame:
    """Rows (keys, issue, row, how): rows at an issue's table row, else on its line, else in its vertical band of the page.

    issues and rows have table_row, line, y and height, null where they don't have such a place. The first way that finds a row counts.
    """
    i = issues.select(*keys, issue, *(F.col(c).alias(f"i_{c}") for c in ("table_row", "line", "y", "height")))
    r = rows.select(*keys, row, "table_row", "line", "y", "height")
    joined = i.join(r, keys)
    overlap = F.least(F.col("i_y") + F.col("i_height"), F.col("y") + F.col("height")) - F.greatest("i_y", "y")
    how = F.when(F.col("i_table_row") == F.col("table_row"), 1).when(F.col("i_line") == F.col("line"), 2).when(overlap >= tolerance * F.least("i_height", "height"), 3)
    found = joined.withColumn("_how", how).where("_how is not null")
    first = found.groupBy(*keys, issue).agg(F.min("_how").alias("_how"))
    names = F.when(F.col("_how") == 1, "table_row").when(F.col("_how") == 2, "line").otherwise("band")
    return found.join(first, [*keys, issue, "_how"]).select(*keys, issue, row, names.alias("how"))
