"""Tree operators: the reference's loader cases on tiny frames."""

from quarry.operators import tree as T


def _files(spark, paths):
    return spark.createDataFrame([(p, "x") for p in paths], "path string, content string")


def test_preorder_parent_before_child(spark):
    man = T.manifest(_files(spark, ["file1.txt", "subdir/file2.txt"]))
    assert [r.path for r in T.preorder(man).collect()] == ["file1.txt", "subdir", "subdir/file2.txt"]


def test_tree_lines_last_child(spark):
    man = T.manifest(_files(spark, ["child1", "child2", "d/x", "d/y"]))
    lines = {r.path: r.line for r in T.tree_lines(man).collect()}
    assert lines["child1"] == "├── child1"
    assert lines["d"] == "└── d"
    assert lines["d/x"] == "    ├── x" and lines["d/y"] == "    └── y"


def test_skip_include_below_exclude(spark):
    f = _files(spark, ["some/path/to/file", "some/path/other", "keep"])
    flat = {r.path for r in T.apply_rules_flat(f, ["some/path"], ["some/path/to"]).collect()}
    assert flat == {"some/path/to/file", "keep"}
    pruned = {r.path for r in T.apply_rules_pruned(f, ["some/path"], ["some/path/to"]).collect()}
    assert pruned == {"keep"}  # the excluded directory is skipped before its include applies


def test_prefix_not_segment_aware(spark):
    f = _files(spark, ["ent/a.go", "entry.go", "main.go"])
    assert {r.path for r in T.apply_rules_flat(f, ["ent"], []).collect()} == {"main.go"}


def test_rollup_adds_up(spark):
    f = _files(spark, ["a/b/c", "a/b/d", "a/e", "f"])
    got = {r.directory: r.n_files for r in T.subtree_file_counts(f).collect()}
    assert got == {"a": 3, "a/b": 2}


def test_blob_hash_matches_git(spark):
    import hashlib
    from quarry.functions.paths import git_blob_hash
    df = spark.createDataFrame([("héllo\n",)], "content string")
    got = df.select(git_blob_hash("content").alias("h")).first().h
    data = "héllo\n".encode()
    assert got == hashlib.sha1(b"blob %d\x00" % len(data) + data).hexdigest()
