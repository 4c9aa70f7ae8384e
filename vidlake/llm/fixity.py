"""Merkle fixity audit of WARC archives: which records of a replica are not those of the original.

Records are hashed; archives are cut into ranges of offsets, whose hashes are combined
FAN at a time up to one hash a file, and over the files up to one root. Two copies are
compared from the roots down, and only the branches that differ are read further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.llm.storage import save

#: Records of one archive file, bytes of one range of offsets, children of a node.
FILE_RECORDS = 1024
RANGE_BYTES = 1 << 16
FAN = 16


def warc_record(url: Column, body: Column) -> Column:
    """A WARC response record; a null url or body is empty."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """(file, offset, length, digest, page_id) of the records of pages (page_id, url, html), written out.

    Page ids decide the file, and the order in it; of equal ids the smaller digest is
    first. Repeated rows are one record. Rows without a page_id are left out.
    """
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    rows = rows.distinct().withColumn("file", F.floor(F.col("page_id") / FILE_RECORDS).cast("long"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return save(rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))), "manifest")


def _above(nodes: DataFrame, width: int, over_files: bool) -> DataFrame:
    """The parents of nodes (file, range, digest): FAN neighbours make one."""
    keys = [F.floor(F.col("file") / FAN).alias("file"), F.lit(0).cast("long").alias("range")] if over_files else [F.col("file"), F.floor(F.col("range") / FAN).alias("range")]
    child = F.concat_ws(":", F.col("file").cast("string"), F.col("range").cast("string"), "digest")
    order = F.struct("file", "range", child.alias("child"))
    grouped = nodes.select(order.alias("o"), *[k.alias(f"up_{n}") for k, n in zip(keys, ("file", "range"))]).groupBy("up_file", "up_range").agg(F.sort_array(F.collect_list("o")).alias("all"))
    return grouped.select(F.col("up_file").alias("file"), F.col("up_range").alias("range"), F.sha2(F.array_join(F.transform("all", lambda x: x["child"]), "\n"), 256).alias("digest"))


def merkle_levels(records: DataFrame, ranges: int, files: int) -> list[DataFrame]:
    """Nodes (file, range, digest) of each level, leaves first. ranges: ranges of the longest file; files: number of the last."""
    placed = records.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES).cast("long"))
    line = F.struct("offset", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").alias("line"))
    leaves = placed.groupBy("file", "range").agg(F.sort_array(F.collect_list(line)).alias("all"))
    levels = [save(leaves.select("file", "range", F.sha2(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), 256).alias("digest")), "level")]
    for over_files, count in ((False, ranges), (True, files)):
        while count > 1:
            levels.append(save(_above(levels[-1], FAN, over_files), "level"))
            count = -(-count // FAN)
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, offset, length, status) of the records that differ; original, replica: (page_id, url, html).

    status: altered (other content under the same page_id), missing, or extra. offset
    and length are the original's, or the replica's for an extra record. Records that
    only moved within their file are whole and not returned. Of ids with several
    records, each is compared by its digest: one that only one side has is missing or
    extra, and altered where both sides have one such. Empty tables give no rows.
    """
    ours, theirs = manifest(original), manifest(replica)
    both = ours.unionByName(theirs).agg(F.max("file"), F.max(F.floor(F.col("offset") / RANGE_BYTES))).first()
    files, ranges = (int(both[0] or 0) + 1, int(both[1] or 0) + 1)
    a, b = merkle_levels(ours, ranges, files), merkle_levels(theirs, ranges, files)
    steps_in_file = 0
    while ranges > 1:
        ranges, steps_in_file = -(-ranges // FAN), steps_in_file + 1
    differing = None
    for k in reversed(range(len(a))):
        x, y = a[k], b[k]
        if differing is not None:
            over = k >= steps_in_file
            up = [F.floor(F.col("file") / FAN), F.lit(0).cast("long")] if over else [F.col("file"), F.floor(F.col("range") / FAN)]
            parents = differing.select(F.col("file").alias("up_file"), F.col("range").alias("up_range"))
            x, y = (t.withColumns({"up_file": up[0], "up_range": up[1]}).join(parents.hint("merge"), ["up_file", "up_range"], "left_semi").select("file", "range", "digest") for t in (x, y))
        y = y.withColumnRenamed("digest", "other")
        differing = save(x.join(y.hint("merge"), ["file", "range"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "range"), "differing")
    near = lambda t: t.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(differing.hint("merge"), ["file", "range"], "left_semi")
    x, y = near(ours), near(theirs)
    only_x = x.join(y.select("page_id", "digest").hint("merge"), ["page_id", "digest"], "left_anti").select("page_id", "file", "offset", "length", F.lit("ours").alias("side"))
    only_y = y.join(x.select("page_id", "digest").hint("merge"), ["page_id", "digest"], "left_anti").select("page_id", "file", "offset", "length", F.lit("theirs").alias("side"))
    one = Window.partitionBy("page_id", "side").orderBy("offset")
    odd = only_x.unionByName(only_y).withColumn("nth", F.row_number().over(one))
    sides = odd.groupBy("page_id", "nth").agg(
        F.min_by(F.struct("file", "offset", "length"), "side").alias("at"), F.min("side").alias("lo"), F.max("side").alias("hi")
    )
    status = F.when(F.col("lo") != F.col("hi"), "altered").when(F.col("lo") == "ours", "missing").otherwise("extra")
    return sides.select("page_id", F.col("at.file").alias("file"), F.col("at.offset").alias("offset"), F.col("at.length").alias("length"), status.alias("status"))
