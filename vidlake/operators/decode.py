"""Raw detector rows to boxes, and second-stage results on targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.functions.geometry import iou
from vidlake.operators.joins import join_small

FRAME = ["channel_index", "frame_index"]


def _first_max(values: Column) -> Column:
    """Place from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decode_yolo(raw: DataFrame, frames: DataFrame, conf: float = 0.5, score: float = 0.5, in_w: int = 416, in_h: int = 416) -> DataFrame:
    """Rows (cx, cy, w, h, objectness, class scores...) to boxes; the stored score is the objectness.

    Coordinates up to 1 are shares of the frame, larger ones pixels of the network's
    input. The filter on objectness stands before the join.
    """
    v = F.col("values")
    rows = raw.where(F.get(v, 4) >= conf).withColumn("scores", F.slice(v, F.lit(6), F.size(v) - 5)).where(F.array_max("scores") >= score)
    # numbers and not lists are sorted for the join
    shares = [F.when(F.get(v, k) <= 1, F.get(v, k)).otherwise(F.get(v, k) / of).alias(f"_v{k}") for k, of in enumerate((in_w, in_h, in_w, in_h))]
    narrow = rows.select(*FRAME, "head", "row_no", *shares, _first_max(F.col("scores")).alias("primary_class_id"), F.get(v, 4).alias("primary_score"))
    both = narrow.join(frames.select(*FRAME, "width", "height").distinct().hint("merge"), FRAME)
    scaled = lambda k, size: (F.col(f"_v{k}") * F.col(size)).cast("int")
    placed = both.select(*FRAME, "head", "row_no", scaled(0, "width").alias("cx"), scaled(1, "height").alias("cy"), scaled(2, "width").alias("w"), scaled(3, "height").alias("h"), "primary_class_id", "primary_score")
    return placed.selectExpr(*FRAME, "head", "row_no", "cast(cx - w div 2 as int) as x", "cast(cy - h div 2 as int) as y", "w as width", "h as height", "primary_class_id", "primary_score")


def decode_ssd(raw: DataFrame, frames: DataFrame, score: float = 0.5) -> DataFrame:
    """Rows (_, class, score, left, top, right, bottom) in shares of the frame to boxes clamped to it."""
    v = F.col("values")
    both = raw.where(F.get(v, 2) > score).join(frames.select(*FRAME, "width", "height").distinct().hint("merge"), FRAME)
    at = lambda k, size: F.greatest(F.lit(0), F.least((F.get(v, k) * F.col(size)).cast("int"), F.col(size) - 1))
    edges = both.select(*FRAME, "row_no", F.get(v, 1).cast("int").alias("primary_class_id"), F.get(v, 2).alias("primary_score"), at(3, "width").alias("l"), at(4, "height").alias("t"), at(5, "width").alias("r"), at(6, "height").alias("b"))
    return edges.selectExpr(*FRAME, "row_no", "l as x", "t as y", "r - l as width", "b - t as height", "primary_class_id", "primary_score")


#: Steps and box sizes of the face detector's four feature maps, and its variances (fixed values).
FACE_STEPS = (8, 16, 32, 64)
FACE_SIZES = ((10, 16, 24), (32, 48), (64, 96), (128, 192, 256))
FACE_VARIANCES = (0.1, 0.2)


def face_priors(frames: DataFrame) -> DataFrame:
    """(width, height, row_no, cx, cy, sx, sy) for each distinct frame size: its prior boxes, in shares, in the order of the rows."""
    out = None
    sizes = frames.select("width", "height").distinct()
    for k, (step, boxes) in enumerate(zip(FACE_STEPS, FACE_SIZES)):
        # each map halves the one before, after a first division by 8
        w = F.floor(F.floor((F.col("width") + 1) / 2) / 2)
        h = F.floor(F.floor((F.col("height") + 1) / 2) / 2)
        for _ in range(k + 1):
            w, h = F.floor(w / 2), F.floor(h / 2)
        grid = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), (h - 1).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), (w - 1).cast("int"))))
        cells = grid.withColumn("size", F.explode(F.array(*map(F.lit, boxes)))).withColumn("map", F.lit(k))
        cells = cells.select("width", "height", "map", "i", "j", "size", ((F.col("j") + 0.5) * step / F.col("width")).alias("cx"), ((F.col("i") + 0.5) * step / F.col("height")).alias("cy"), (F.col("size") / F.col("width")).alias("sx"), (F.col("size") / F.col("height")).alias("sy"))
        out = cells if out is None else out.unionByName(cells)
    order = Window.partitionBy("width", "height").orderBy("map", "i", "j", "size")
    return out.withColumn("row_no", F.row_number().over(order) - 1).drop("map", "i", "j", "size")


def decode_face(rows: DataFrame, frames: DataFrame, score: float = 0.7) -> DataFrame:
    """Face rows (loc ARRAY of 14: box and five landmarks, cls, iou_score) to boxes in pixels, with the frame's priors."""
    sized = rows.join(frames.select(*FRAME, "width", "height").distinct().hint("merge"), FRAME)
    # priors are bounded by the picture sizes, which are few: a size has some thousand
    both = join_small(sized, face_priors(frames), ["width", "height", "row_no"])
    v, (near, far) = F.col("loc"), FACE_VARIANCES
    scored = both.withColumn("score", F.sqrt(F.col("cls") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("iou_score"))))).where(F.col("score") > score)
    cx, cy = F.col("cx") + F.get(v, 0) * near * F.col("sx"), F.col("cy") + F.get(v, 1) * near * F.col("sy")
    # the width goes by the first variance, the height by the second
    w, h = F.col("sx") * F.exp(F.get(v, 2) * near), F.col("sy") * F.exp(F.get(v, 3) * far)
    points = F.array(*[F.struct(((F.col("cx") + F.get(v, 4 + 2 * k) * near * F.col("sx")) * F.col("width")).cast("int").alias("x"), ((F.col("cy") + F.get(v, 5 + 2 * k) * near * F.col("sy")) * F.col("height")).cast("int").alias("y")) for k in range(5)])
    return scored.select(
        *FRAME, "row_no", ((cx - w / 2) * F.col("width")).cast("int").alias("x"), ((cy - h / 2) * F.col("height")).cast("int").alias("y"),
        (w * F.col("width")).cast("int").alias("box_width"), (h * F.col("height")).cast("int").alias("box_height"), F.round("score", 6).alias("score"), points.alias("key_points"),
    )


def nms(targets: DataFrame, threshold: float = 0.5, score: float = 0.0, top_k: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression of each frame, whatever the class; equal scores by row_no. A frame's boxes fit in one row."""
    box = F.struct((-F.col("primary_score")).alias("order"), "row_no", "x", "y", "width", "height", "primary_class_id", "primary_score")
    frames = targets.where(F.col("primary_score") >= score).groupBy(*FRAME).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    boxes = F.slice("boxes", 1, top_k) if top_k else F.col("boxes")
    kind = "array<struct<order:double,row_no:int,x:int,y:int,width:int,height:int,primary_class_id:int,primary_score:double>>"
    kept = F.aggregate(boxes, F.array().cast(kind), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b)).cast(kind)))
    return frames.select(*FRAME, F.posexplode(kept).alias("target_no", "b")).select(*FRAME, "target_no", "b.row_no", "b.x", "b.y", "b.width", "b.height", "b.primary_class_id", "b.primary_score")


def clip_boxes(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes within their frame; the width is not cut by what x was below 0. Boxes without area are dropped."""
    size = frames.select(*FRAME, F.col("width").alias("fw"), F.col("height").alias("fh")).distinct()
    both = targets.join(size.hint("merge"), FRAME).withColumn("x", F.greatest(F.col("x"), F.lit(0))).withColumn("y", F.greatest(F.col("y"), F.lit(0)))
    cut = both.withColumn("width", F.least(F.col("width"), F.col("fw") - F.col("x"))).withColumn("height", F.least(F.col("height"), F.col("fh") - F.col("y")))
    return cut.where("width > 0 and height > 0").drop("fw", "fh")


def label_lookup(targets: DataFrame, labels: DataFrame, column: str = "primary_label") -> DataFrame:
    """The label of each class id; labels: (class_id, label), a line of a label file each, without a carriage return. Unknown ids are empty."""
    clean = labels.select(F.col("class_id").alias("primary_class_id"), F.regexp_replace("label", "\r$", "").alias(column))
    return join_small(targets, clean, "primary_class_id", "left").withColumn(column, F.coalesce(column, F.lit("")))


def merge_detectors(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Targets of several detectors of the same frames: class ids get each detector's offset (labels were looked up before), and target_no counts on in order."""
    out = None
    for k, (df, offset) in enumerate(parts):
        one = df.withColumn("primary_class_id", F.col("primary_class_id") + offset).withColumn("detector", F.lit(k))
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy(*FRAME).orderBy("detector", "target_no")
    return out.withColumn("target_no", (F.row_number().over(order) - 1).cast("int"))


def gate_targets(targets: DataFrame, class_ids: Sequence[int] = (), min_width: int = 0, min_height: int = 0) -> DataFrame:
    """Targets of a size, and of the classes where any are given."""
    sized = targets.where((F.col("width") >= min_width) & (F.col("height") >= min_height))
    return sized.where(F.col("primary_class_id").isin(*class_ids)) if class_ids else sized


def crop_boxes(targets: DataFrame, frame_width: int, frame_height: int, padding: int = 10) -> DataFrame:
    """Boxes with a margin, clamped to the frame; without padding they stay."""
    if not padding:
        return targets
    wide = targets.withColumns({"x": F.greatest(F.col("x") - padding, F.lit(0)), "y": F.greatest(F.col("y") - padding, F.lit(0)), "width": F.col("width") + 2 * padding, "height": F.col("height") + 2 * padding})
    return wide.withColumns({"width": F.least(F.col("width"), frame_width - F.col("x")), "height": F.least(F.col("height"), frame_height - F.col("y"))})


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def classify(scores: DataFrame, labels: Sequence[str], normalize: bool = True) -> DataFrame:
    """scores with class_id (the first greatest), its score (after softmax) and label; a row of scores a target."""
    v = F.col("scores")
    best = scores.withColumn("class_id", _first_max(v))
    value = 1 / F.aggregate(F.transform(v, lambda s: F.exp(s - F.array_max(v))), F.lit(0.0), lambda a, x: a + x) if normalize else F.array_max(v)
    return best.withColumn("class_score", F.round(value, 6)).withColumn("class_label", F.coalesce(F.get(F.array(*map(F.lit, labels)), "class_id"), F.lit("")))


def attach(targets: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """targets with a column of results (channel_index, frame_index, target_no, column), null where there is none."""
    return targets.drop(column).join(results.select(*FRAME, "target_no", column).hint("merge"), [*FRAME, "target_no"], "left")


def attach_secondary(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """targets with secondary: labels of all their classes (channel_index, frame_index, target_no, class_label), in order of class_id."""
    lists = classes.groupBy(*FRAME, "target_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "class_label"))), lambda c: c["class_label"]).alias("secondary"))
    return attach(targets, lists, "secondary").withColumn("secondary", F.coalesce("secondary", F.array().cast("array<string>")))


def attach_subtargets(targets: DataFrame, plates: DataFrame, frame_width: int, frame_height: int) -> DataFrame:
    """Plates found on a target's crop, in frame coordinates: class -1, score 0, label color_text. Empty texts and boxes are dropped."""
    both = targets.select(*FRAME, "target_no", F.col("x").alias("tx"), F.col("y").alias("ty")).join(plates.where("text <> ''").hint("merge"), [*FRAME, "target_no"])
    placed = both.withColumns({"x": F.greatest(F.lit(0), F.col("x") + F.col("tx") - 10), "y": F.greatest(F.lit(0), F.col("y") + F.col("ty") - 8)})
    return _plates(placed, frame_width, frame_height, [*FRAME, "target_no"])


def plate_targets(plates: DataFrame, frame_width: int, frame_height: int) -> DataFrame:
    """Plates found on whole frames as targets of their own."""
    placed = plates.where("text <> ''").withColumns({"x": F.greatest(F.lit(0), F.col("x")), "y": F.greatest(F.lit(0), F.col("y"))})
    return _plates(placed, frame_width, frame_height, FRAME)


def _plates(placed: DataFrame, frame_width: int, frame_height: int, keys: list[str]) -> DataFrame:
    cut = placed.withColumns({"width": F.least(F.col("width"), frame_width - F.col("x")), "height": F.least(F.col("height"), frame_height - F.col("y"))}).where("width > 0 and height > 0")
    return cut.select(*keys, "x", "y", "width", "height", F.lit(-1).alias("class_id"), F.lit(0.0).alias("score"), F.concat_ws("_", "color", "text").alias("label"))


def text_targets(rows: DataFrame) -> DataFrame:
    """Recognised text rows (x1, y1 ... x4, y4, text, score) with their region as four points."""
    region = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(1, 5)])
    return rows.select(*FRAME, "target_no", region.alias("region"), "text", "score")


def pose_from_vector(rows: DataFrame) -> DataFrame:
    """51 values to 17 key points (point_type 0 to 16, x, y, score)."""
    v = F.col("values")
    point = lambda j: F.struct(j.alias("point_type"), F.get(v, j * 3).cast("int").alias("x"), F.get(v, j * 3 + 1).cast("int").alias("y"), F.get(v, j * 3 + 2).alias("score"))
    return rows.withColumn("key_points", F.transform(F.sequence(F.lit(0), F.lit(16)), point))


def limb_pairs(candidates: DataFrame, share: float = 0.7, threshold: float = 0.1) -> DataFrame:
    """For each first joint of a limb the second joint with the best mean of sampled scores, among those with enough samples above the threshold.

    candidates: (channel_index, frame_index, limb, a_id, b_id, samples ARRAY); the smaller b_id wins a tie.
    """
    v = F.col("samples")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    good = candidates.where(F.size(F.filter(v, lambda s: s > threshold)) > share * F.size(v)).withColumn("mean", mean)
    best = good.groupBy(*FRAME, "limb", "a_id").agg(F.max_by(F.struct("b_id", "mean"), F.struct("mean", (-F.col("b_id")).alias("o"))).alias("b"))
    return best.select(*FRAME, "limb", "a_id", F.col("b.b_id").alias("b_id"), F.round("b.mean", 6).alias("score"))


def assemble_poses(pairs: DataFrame, limbs: Sequence[tuple[int, int]], points: int) -> DataFrame:
    """Persons of each frame from its limb pairs (channel_index, frame_index, limb, a_id, b_id), folded in order of limb.

    limbs: the joints each limb goes from and to. A pair joins the first person that holds
    its first joint, else starts one while limb < points - 1. Returns (channel_index,
    frame_index, person, joints ARRAY of candidate ids, -1 where missing). One frame's
    pairs are one group.
    """

    kind, number = "array<array<int>>", lambda k: F.array(*[F.lit(limb[k]) for limb in limbs])

    def fold(persons: Column, pair: Column) -> Column:
        start, end = F.get(number(0), pair["limb"]), F.get(number(1), pair["limb"])
        fresh = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.when(k == end, pair["b_id"]).when(k == start, pair["a_id"]).otherwise(-1))

        def joined(at: Column) -> Column:
            grown = F.transform(persons, lambda p, i: F.when(i + 1 == at, F.transform(p, lambda v, k: F.when(k == end, pair["b_id"]).otherwise(v))).otherwise(p))
            return F.when(at > 0, grown).when(pair["limb"] < points - 1, F.concat(persons, F.array(fresh))).otherwise(persons)

        # the place of the first holder, once for all that follows
        at = F.array_position(F.transform(persons, lambda p: F.get(p, start)), pair["a_id"])
        return F.get(F.transform(F.array(at), joined), 0).cast(kind)

    steps = pairs.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("limb", "a_id", "b_id")]))).alias("steps"))
    persons = F.aggregate("steps", F.array().cast(kind), fold)
    return steps.select(*FRAME, F.posexplode(persons).alias("person", "joints"))


def mask_argmax(cells: DataFrame) -> DataFrame:
    """The class of each cell (channel_index, frame_index, cell, scores): the first greatest channel, 0 where none is above it."""
    return cells.withColumn("class_id", _first_max(F.col("scores")))


def mask_coverage(cells: DataFrame) -> DataFrame:
    """Cells of each class per frame."""
    return mask_argmax(cells).groupBy(*FRAME, "class_id").agg(F.count(F.lit(1)).alias("cells"))


def mask_binary(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Cells per frame whose score is above a threshold."""
    return cells.groupBy(*FRAME).agg(F.count_if(F.col("score") > threshold).alias("cells"))
