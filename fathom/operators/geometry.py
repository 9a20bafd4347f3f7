"""Tiles and boxes of annotated images. Images, tiles and boxes are rows; positions are arrays of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.ordered import numbered
from fathom.staging import staged


#: Hexadecimal digits of a hash that a sample's bins are told by.
BIN_DIGITS = 3


def stride_positions(size: Column, tile: int, stride: int) -> Column:
    """0, stride, ... while a tile fits, and one flush with the edge if the last leaves something uncovered."""
    inner = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(stride))
    last = F.element_at(inner, -1)
    return F.when(last + tile < size, F.concat(inner, F.array(size - tile))).otherwise(inner)


def plain_positions(size: Column, tile: int) -> Column:
    """Tiles side by side; what is left at the edge is dropped."""
    return F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(tile)) if tile > 0 else F.array().cast("array<int>")


def fixed_positions(size: Column, tile: int, count: int, spread: bool = False) -> Column:
    """count tiles: side by side from the start, or spread evenly with the last one flush."""
    if count <= 0:
        return F.array().cast("array<int>")
    if not spread:
        return F.array(*(F.lit(k * tile) for k in range(count)))
    if count == 1:
        return F.array(F.lit(0))
    step = (size - tile) / (count - 1)
    return F.array(*((step * k).cast("int") for k in range(count - 1)), F.greatest(size - tile, F.lit(0)))


def overlapping_positions(size: Column, tile: int = 1024, count: int = 3, overlap: float = 0.2) -> Column:
    """count tiles at a step of tile less the overlap, kept inside; on small images some coincide."""
    step = max(1, int(tile * (1.0 - overlap)))
    return F.array(*(F.least(F.lit(k * step), F.greatest(size - tile, F.lit(0))) for k in range(count)))


def tiles(images: DataFrame, xs: Column, ys: Column) -> DataFrame:
    """images with row, col, x, y: the grid of both position arrays, in rows."""
    rows = images.withColumn("_ys", ys).withColumn("_xs", xs)
    rows = rows.select(*images.columns, "_xs", F.posexplode("_ys").alias("row", "y"))
    return rows.select(*images.columns, "row", "y", F.posexplode("_xs").alias("col", "x"))


def tile_name(stem: Column, suffix: Column, index: Column, row: Column, col: Column, style: str = "index", pad: int = 3, order: str = "col_row", base: int = 0) -> Column:
    """stem_index, stem with a zero-padded index, or stem_col_row (stem_row_col)."""
    if style == "index_zero_pad":
        tail = F.lpad(index.cast("string"), pad, "0")
    elif style == "grid_rc":
        a, b = (row, col) if order == "row_col" else (col, row)
        tail = F.concat_ws("_", (a + base).cast("string"), (b + base).cast("string"))
    else:
        tail = index.cast("string")
    return F.concat(stem, F.lit("_"), tail, suffix)


def tile_of(name: Column) -> Column:
    """(name, row, col) of DJI_n_row_col.JPG, null for other names."""
    p = r"(?i)^(DJI_\d+)_(\d+)_(\d+)\.JPG$"
    part = lambda k: F.regexp_extract(name, p, k)
    return F.when(name.rlike(p), F.struct(part(1).alias("name"), part(2).cast("int").alias("row"), part(3).cast("int").alias("col")))


def overlapping(placed: DataFrame, boxes: DataFrame, tile: int, image: str = "image_id") -> DataFrame:
    """Every tile with every box of its image that overlaps it, once.

    Both are put in the cells of a grid, tile wide, that they touch, and meet in an equi-join on the cell, so what the join
    makes grows with the overlaps and an image of any number of boxes is spread over its cells. Of the cells that a pair
    shares, the one that holds the upper left corner of their overlap makes the row. Both sides are shuffled: Spark takes
    the size of tiles from that of the images, many times too small, and would send them all through the driver.
    """
    cell = lambda c: F.floor(c / tile)
    span = lambda low, high: F.sequence(cell(low), F.greatest(cell(low), cell(high)))
    x, y, bx, by = (F.col(c) for c in ("x", "y", "bx", "by"))
    gridded = placed.withColumn("_cy", F.explode(span(y, y + tile - 1))).withColumn("_cx", F.explode(span(x, x + tile - 1)))
    solid = boxes.where((F.col("bw") > 0) & (F.col("bh") > 0))
    met = solid.withColumn("_cy", F.explode(span(by, by + F.col("bh")))).withColumn("_cx", F.explode(span(bx, bx + F.col("bw"))))
    owner = (F.col("_cx") == cell(F.greatest(bx, x))) & (F.col("_cy") == cell(F.greatest(by, y)))
    return gridded.hint("merge").join(met, [image, "_cx", "_cy"]).where(owner).drop("_cx", "_cy")


def clip_boxes(placed: DataFrame, boxes: DataFrame, tile: int, pad: bool = False, image: str = "image_id") -> DataFrame:
    """Boxes (image, ann_id, category_id, bx, by, bw, bh) cut to the tiles (image, width, height, row, col, x, y) that they
    overlap, in the tile's coordinates, with their area. Tiles that reach over the image's edge count only if pad."""
    inside = placed if pad else placed.where((F.col("x") + tile <= F.col("width")) & (F.col("y") + tile <= F.col("height")))
    j = overlapping(inside, boxes, tile, image)
    x1, y1 = F.greatest("bx", "x"), F.greatest("by", "y")
    x2, y2 = F.least(F.col("bx") + F.col("bw"), F.col("x") + tile), F.least(F.col("by") + F.col("bh"), F.col("y") + tile)
    hit = j.where((x2 > x1) & (y2 > y1))
    w, h = x2 - x1, y2 - y1
    return hit.select(image, "row", "col", "ann_id", "category_id", (x1 - F.col("x")).alias("bx"), (y1 - F.col("y")).alias("by"), w.alias("bw"), h.alias("bh"), (w * h).cast("double").alias("area"))


def renumber(clipped: DataFrame, image: str = "image_id") -> DataFrame:
    """clipped with tile_no and new_ann_id from 0, in the order of image, row, column and annotation. Numbers are dense
    over the whole table; both tiles and rows are numbered by ranges, so no task holds an image."""
    rows = numbered(clipped, [image, "row", "col", "ann_id"], "new_ann_id")
    tile_nos = numbered(rows.select(image, "row", "col").distinct(), [image, "row", "col"], "tile_no")  # rows are staged, boxes are cut once
    return rows.join(tile_nos, [image, "row", "col"]).select(*clipped.columns, "tile_no", "new_ann_id")


def to_full(boxes: DataFrame, tile: int = 1024) -> DataFrame:
    """Boxes of tiles (row, col) in the coordinates of the whole image."""
    return boxes.withColumn("bx", F.col("bx") + F.col("col") * tile).withColumn("by", F.col("by") + F.col("row") * tile)


def group_by_original(images: DataFrame, boxes: DataFrame, tile: int = 1024) -> DataFrame:
    """original, boxes: those of all its tiles, in whole-image coordinates; images with other names drop out."""
    named = images.select("image_id", tile_of(F.col("file_name")).alias("t")).where("t is not null").select("image_id", F.col("t.name").alias("original"), "t.row", "t.col")
    full = to_full(boxes.join(named, "image_id"), tile)
    return full.groupBy("original").agg(F.array_sort(F.collect_list(F.struct("row", "col", "ann_id", "category_id", "bx", "by", "bw", "bh"))).alias("boxes"))


def clamp_box(bx: Column, by: Column, bw: Column, bh: Column, width: Column, height: Column) -> Column:
    """Corners rounded half to even and kept inside the image."""
    r = lambda c: F.bround(c, 0).cast("int")
    return F.struct(F.greatest(r(bx), F.lit(0)).alias("x1"), F.greatest(r(by), F.lit(0)).alias("y1"), F.least(r(bx + bw), width).alias("x2"), F.least(r(by + bh), height).alias("y2"))


def crop_box(bx: Column, by: Column, bw: Column, bh: Column, width: Column, height: Column, padding: int) -> Column:
    """Corners of the box with padding, cut to integers and kept inside the image."""
    i = lambda c: c.cast("int")
    return F.struct(
        F.greatest(i(bx - padding), F.lit(0)).alias("x1"), F.greatest(i(by - padding), F.lit(0)).alias("y1"), F.least(i(bx + bw + padding), width).alias("x2"), F.least(i(by + bh + padding), height).alias("y2")
    )


def category_counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("category_id").agg(F.count("*").alias("n"))


def primary_category(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """image, category_id: the most frequent category, of equals the first seen (by ann_id)."""
    counts = boxes.where("category_id is not null").groupBy(image, "category_id").agg(F.count("*").alias("n"), F.min("ann_id").alias("first"))
    return counts.groupBy(image).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "category_id"))["category_id"].alias("category_id"))


def allocate(counts: DataFrame, total: int, key: str = "category_id") -> DataFrame:
    """key, n, taken: total dealt out in proportion to n; what whole shares leave over goes by remainder, then key, descending.
    counts has a row per stratum."""
    all_ = Window.partitionBy()
    raw = F.col("n") / F.sum("n").over(all_) * total
    shared = counts.withColumn("_raw", raw).withColumn("_base", F.floor("_raw"))
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("_raw") - F.col("_base")).desc(), F.col(key).desc()))
    left = F.lit(total) - F.sum("_base").over(all_)
    return shared.withColumn("_p", place).withColumn("_l", left).select(key, "n", (F.col("_base") + (F.col("_p") <= F.col("_l")).cast("long")).alias("taken"))


def stratified_sample(items: DataFrame, total: int, id: str, stratum: str, seed: str = "0") -> DataFrame:
    """items by allocation to their strata; inside one, those whose MD5 of seed and id is smallest, of equals the smallest
    ids. Items with a null stratum or id belong to none.

    No stratum is sorted. Hashes are counted by stratum and first BIN_DIGITS hexadecimal digits; the bin in which the
    count reaches what is to be taken is the boundary. Items of bins below it are taken whole by a filter, and only those of
    the boundary are put in order.
    """
    own = items.where(F.col(id).isNotNull() & F.col(stratum).isNotNull())
    hashed = own.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(id).cast("string")))).withColumn("_bin", F.substring("_hash", 1, BIN_DIGITS))
    bins = staged(hashed.groupBy(stratum, "_bin").agg(F.count("*").alias("n")), "bins")  # at most 16 ** BIN_DIGITS rows a stratum
    taken = allocate(bins.groupBy(stratum).agg(F.sum("n").alias("n")), total, stratum).withColumn("taken", F.least("taken", "n"))
    upto = F.sum("n").over(Window.partitionBy(stratum).orderBy("_bin"))
    edges = bins.withColumn("_upto", upto).join(taken.select(stratum, "taken"), stratum).where(F.col("_upto") >= F.col("taken"))
    edges = edges.groupBy(stratum).agg(F.min("_bin").alias("_edge"), F.min("taken").alias("taken"), F.min_by(F.col("_upto") - F.col("n"), "_bin").alias("_below"))
    met = hashed.join(F.broadcast(staged(edges, "edges")), stratum)  # a row for each stratum, as allocate() has them
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_hash", id))
    edge = met.where(F.col("_bin") == F.col("_edge")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("taken") - F.col("_below"))
    return met.where(F.col("_bin") < F.col("_edge")).select(items.columns).unionByName(edge.select(items.columns))


def subset(images: DataFrame, boxes: DataFrame, wanted: DataFrame) -> DataFrame:
    """pos, file_name, status, image_id, n_boxes of wanted names (pos, file_name), in their order: missing, duplicate (asked
    for before) or found. Names are compared by their last part without case; the first image of a name counts."""
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    known = images.groupBy(base(F.col("file_name")).alias("_name")).agg(F.min("image_id").alias("image_id"))
    asked = wanted.withColumn("_name", base(F.col("file_name"))).withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy("pos")))
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("n_boxes"))
    j = asked.join(known, "_name", "left").join(counts, "image_id", "left")
    status = F.when(F.col("image_id").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("found")
    return j.select("pos", "file_name", status.alias("status"), "image_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


def with_category(images: DataFrame, boxes: DataFrame, category: int, most: int) -> DataFrame:
    """The first images (by id) that have a box of the category."""
    return images.join(boxes.where(F.col("category_id") == category), "image_id", "left_semi").orderBy("image_id").limit(most)


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """name, path, reason: the file with that relative path, else the only one with that base name; else not_found or
    ambiguous. files has path; letters' case does not count."""
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    exact = files.groupBy(F.lower("path").alias("_p")).agg(F.min("path").alias("exact"))
    by_name = files.groupBy(base(F.col("path")).alias("_b")).agg(F.min("path").alias("only"), F.count("*").alias("n"))
    j = wanted.withColumn("_p", F.lower("name")).withColumn("_b", base(F.col("name"))).join(exact, "_p", "left").join(by_name, "_b", "left")
    path = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    return j.select("name", path.alias("path"), F.when(path.isNotNull(), "ok").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("reason"))

