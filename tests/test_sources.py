"""Sources: a real file tree via binaryFile, snapshot partition pruning and pushdown."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.plans.inspect import plan_text
from quarry.sources import corpus as C
from quarry.sources.files import read_snapshot, read_tree, write_snapshot


def test_read_tree_relative_paths(spark):
    root = tempfile.mkdtemp(prefix="quarry-tree-")
    os.makedirs(os.path.join(root, "a", "b"))
    for p, txt in (("a/x.go", "package a\n"), ("a/b/y.tf", "x = 1\n"), ("top.txt", "")):
        with open(os.path.join(root, p), "w") as f:
            f.write(txt)
    got = {r.path: (r.size, r.content) for r in read_tree(spark, root).collect()}
    # Spark's file scan skips zero-length files, so top.txt is not listed
    assert got == {"a/x.go": (10, "package a\n"), "a/b/y.tf": (6, "x = 1\n")}
    # unless a listing names it
    listing = spark.createDataFrame([(p,) for p in ("a/x.go", "a/b/y.tf", "top.txt")], "path string").select(
        "path", F.lit(None).cast("timestamp_ntz").alias("modified_at"))
    got = {r.path: (r.size, r.content) for r in read_tree(spark, root, listing=listing).collect()}
    assert got == {"a/x.go": (10, "package a\n"), "a/b/y.tf": (6, "x = 1\n"), "top.txt": (0, "")}


def test_snapshot_scope_read_prunes_partitions_and_columns(spark):
    out = tempfile.mkdtemp(prefix="quarry-snap-") + "/s"
    st = C.doc_state(spark, "/root/testdata/sf0.001").withColumn(
        "embedding", F.array(F.lit(0.5).cast("float")))
    write_snapshot(st, out)
    df = read_snapshot(spark, out, repository="repo1", context="en", columns=["id", "filepath"],
                       where=F.col("filepath").startswith("src1"))
    txt = plan_text(df)
    assert "PartitionFilters: [isnotnull(repository" in txt and "(repository#" in txt
    assert "StringStartsWith(filepath,src1)" in txt
    assert "ReadSchema: struct<id:bigint,filepath:string>" in txt
    exp = st.filter("repository = 'repo1' AND context = 'en' AND filepath LIKE 'src1%'").count()
    assert df.count() == exp
