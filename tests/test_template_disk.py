"""What line templates write while they run."""

import os

from pyspark.sql import functions as F

from runscope.operators import ranking, templates


def test_lines_are_kept_once_and_packed(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.translate(
        F.substring(F.md5(F.concat_ws("-", "id", i)), 1, 8), "0123456789", "ghijklmnop")), " ")
    lines = spark.range(20000).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("cluster_id"), F.lit("f").alias("file_path"),
        F.col("id").cast("int").alias("line_number"), words.alias("line")).localCheckpoint()
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0]

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names)

    at = ranking.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = used()
    found = templates.line_templates(lines).collect()
    assert sum(r.lines for r in found) == sum(r.distinct_lines for r in found) == 20000
    assert used() - before < 1.5 * size
