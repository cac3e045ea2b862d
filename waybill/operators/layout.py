"""Words of pages to lines, paragraphs, cells and reading order. Windows and joins are partitioned by document and page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from waybill.functions import geometry as G
from waybill.session import python_trim

LINE_GAP = 3.0
PAGE = ("doc_id", "page")


def word_lines(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """Words with ``line_ix``: sorted by rounded top, then left; a line ends where the top moves by more than the gap."""
    w = Window.partitionBy(*PAGE).orderBy(F.round("top", 1), "x0", "word_ix")
    new = F.coalesce((F.abs(F.col("top") - F.lag("top").over(w)) > gap).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("line_ix", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lines(words: DataFrame) -> DataFrame:
    """One row per line: box, mean size, whether any word is bold, text from left to right."""
    bold = F.lower(F.col("fontname")).contains("bold") if "fontname" in words.columns else F.lit(False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ix", "text"))), lambda x: x["text"]), " ")
    return word_lines(words).groupBy(*PAGE, "line_ix").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.avg("size").alias("size"), F.bool_or(bold).alias("bold"), text.alias("text"))


def paragraphs(line_rows: DataFrame, page_width: float | None = None) -> DataFrame:
    """One row per paragraph: a new one begins after a gap of over 0.9 line heights or a change of size by over 2."""
    w = Window.partitionBy(*PAGE).orderBy("line_ix")
    height = F.greatest(F.lag("bottom").over(w) - F.lag("top").over(w), F.lit(1.0))
    new = F.coalesce(((F.col("top") - F.lag("bottom").over(w) > 0.9 * height) | (F.abs(F.col("size") - F.lag("size").over(w)) > 2)).cast("int"), F.lit(0))
    marked = line_rows.withColumn("_new", new).withColumn("para_ix", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda x: x["text"]), "\n")
    out = marked.groupBy(*PAGE, "para_ix").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.avg("size").alias("size"), (2 * F.count_if("bold") >= F.count("*")).alias("bold"), F.count("*").alias("n_lines"), text.alias("text"))
    return out.withColumn("centred", G.is_centred(F.col("x0"), F.col("x1"), F.lit(page_width))) if page_width else out


def clusters(positions: DataFrame, keys: list[str], position: str, gap: float) -> DataFrame:
    """(keys, cluster_ix, centre, n): positions apart by no more than the gap are one cluster; the centre is the mean, cut."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    marked = positions.withColumn("_new", new).withColumn("cluster_ix", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "cluster_ix").agg(F.avg(position).cast("int").alias("centre"), F.count("*").alias("n"))


def profile_peaks(ink: DataFrame, keys: list[str], position: str, value: str, share: float = 0.3, gap: float = 5) -> DataFrame:
    """Clusters of the positions whose summed ink exceeds a share of the largest sum."""
    sums = ink.groupBy(*keys, position).agg(F.sum(value).alias("_v"))
    top = sums.withColumn("_m", F.max("_v").over(Window.partitionBy(*keys))).where(F.col("_v") > share * F.col("_m"))
    return clusters(top.select(*keys, position), keys, position, gap)


def anchored_lines(words: DataFrame, share: float = 0.6) -> DataFrame:
    """Words with ``line_ix``: a word joins the line while its top is within ``share`` of the line's largest size of the line's top.

    The rule depends on all of the line so far, so it is a fold over each page's sorted words, in one pass over Arrow
    batches; the state is carried from batch to batch. Words are never joined to themselves, as the planner would judge
    them by the stored texts they come from and broadcast them.
    """
    page = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_ix", "size", "text")
    keys = [*PAGE, "word_ix"]
    rest = [c for c in words.columns if c not in keys]
    kept = words.select(*PAGE, F.col("word_ix").cast("bigint").alias("word_ix"), *rest)
    marked = kept.select("*", (F.row_number().over(page) == 1).alias("_new"), F.col("top").cast("double").alias("_top"), F.col("size").cast("double").alias("_size"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, first, largest = -1, None, None
        for batch in batches:
            out = []
            for new, top, size in zip(*(batch.column(c).to_pylist() for c in ("_new", "_top", "_size")), strict=True):
                # as SQL compares: nothing is within a null, everything is within NaN
                if not new and first is not None and largest is not None and top is not None and (top - first <= share * largest or largest != largest):
                    if size is not None and (size > largest or size != size):
                        largest = size
                else:
                    line, first, largest = 0 if new else line + 1, top, size
                out.append(line)
            columns = {c: batch.column(c) for c in keys} | {"line_ix": pa.array(out, pa.int32())} | {c: batch.column(c) for c in rest}
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    head, tail = kept.schema.fields[:3], kept.schema.fields[3:]
    return marked.mapInArrow(fold, StructType([*head, StructField("line_ix", IntegerType()), *tail]))


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words joined to the boxes that hold their centre; the page is the join's key, the box a range condition on it."""
    b = boxes.select(*PAGE, "box_ix", *[F.col(c).alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return words.join(b, [*PAGE]).where(cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_top"), F.col("_bottom"))).drop("_x0", "_top", "_x1", "_bottom")


def words_outside_boxes(words: DataFrame, boxes: DataFrame, whole: bool = True) -> DataFrame:
    """Words that no box holds: wholly with one point of slack, or by their centre."""
    b = boxes.select(*[F.col(k).alias(f"_{k}") for k in PAGE], *[F.col(c).alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (F.col("x0") >= F.col("_x0") - 1) & (F.col("x1") <= F.col("_x1") + 1) & (F.col("top") >= F.col("_top") - 1) & (F.col("bottom") <= F.col("_bottom") + 1)
    centre = cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_top"), F.col("_bottom"))
    return words.join(b, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & (inside if whole else centre), "left_anti")


def upper_median(value: str) -> "F.Column":
    """Aggregate: the element at half the count, upper for even counts; 11 if there is none."""
    ordered = F.array_sort(F.collect_list(value))
    return F.coalesce(F.get(ordered, (F.size(ordered) / 2).cast("int")), F.lit(11.0))


def image_of_box(signatures: DataFrame, images: DataFrame) -> DataFrame:
    """The embedded image that shows each document's signature box: by overlap of 0.3 at least, else centre distance up to 0.08."""
    met = signatures.join(images, [*PAGE])
    size, common, apart = G.area(F.col("image_box")), G.overlap(F.col("box"), F.col("image_box")), G.centre_distance(F.col("box"), F.col("image_box"))
    score = F.when(common >= 0.3, common).when(apart <= 0.08, 0.3 - apart)
    scored = met.withColumn("score", score).where((size > 0) & (size <= 0.5) & score.isNotNull())
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "image_ix")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def nearest_picture(anchors: DataFrame, pictures: DataFrame, reach: int = 3) -> DataFrame:
    """The first picture within ``reach`` paragraphs of each anchor, the anchor's own paragraph first."""
    p = pictures.select("doc_id", F.col("para_ix").alias("_p"), "picture_ix")
    near = anchors.join(p, "doc_id").where(F.abs(F.col("_p") - F.col("para_ix")) <= reach)
    w = Window.partitionBy("doc_id", "para_ix").orderBy((F.col("_p") != F.col("para_ix")).cast("int"), "_p", "picture_ix")
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "para_ix", "picture_ix", F.col("_p").alias("picture_para"))


def reading_order(*blocks: DataFrame) -> DataFrame:
    """Blocks of several kinds in one sequence by page and top; ``seq`` keeps equal places in the order of the kinds given."""
    out = None
    for k, b in enumerate(blocks):
        b = b.withColumn("_kind_ix", F.lit(k))
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page", "top", "_kind_ix")
    return out.withColumn("seq", F.row_number().over(w)).drop("_kind_ix")


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("text", "table", "image")])


def block_style(size, bold, median):
    """struct<font, heading>: the size a block is printed in, 8 to 36 points, and whether it is a heading."""
    return F.struct(F.greatest(F.lit(8.0), F.least(size, F.lit(36.0))).alias("font"), G.is_heading(size, bold, median).alias("heading"))


def ocr_words(raw: DataFrame, dpi: int = 300, least: float = 40) -> DataFrame:
    """Recognised words that aren't empty, by confidence, in points."""
    scale = 72.0 / dpi
    kept = raw.where((python_trim("text") != "") & (F.col("conf") >= least))
    return kept.select("doc_id", "page", "word_ix", python_trim("text").alias("text"), *[(F.col(c) * scale).alias(c) for c in ("x0", "x1", "top", "bottom")], F.greatest(F.lit(6.0), (F.col("bottom") - F.col("top")) * scale * 0.8).alias("size"))


def once_per_cell(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_ix", "row_ix")) -> DataFrame:
    """Cells of rows in which a merged cell is listed once for each column it spans, each once, at its first place."""
    return cells.groupBy(*keys, "cell_id").agg(F.min("cell_ix").alias("cell_ix"), F.min_by("text", "cell_ix").alias("text"))


def table_width(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_ix")) -> DataFrame:
    """(keys, n_rows, n_cols): the length of each table's longest row."""
    rows = cells.groupBy(*keys, "row_ix").agg(F.count("*").alias("_n"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max("_n").alias("n_cols"))
