"""Explicit StructTypes of the data model (no schema inference on nested input)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _f(name, t, nullable=True):
    return T.StructField(name, t, nullable)


# documents table; unique key (repository, context, filepath)
DOCUMENT = T.StructType([
    _f("id", L, False), _f("repository", S, False), _f("context", S, False), _f("filepath", S, False),
    _f("description", S, False), _f("updated_at", T.TimestampNTZType(), False),
    _f("embedding", T.ArrayType(T.FloatType(), True), False),
])
DOCUMENT_KEY = ("repository", "context", "filepath")

# flat manifest node (the reference's recursive FileInfo, flattened)
MANIFEST_NODE = T.StructType([
    _f("path", S), _f("name", S), _f("parent", S), _f("depth", I),
    _f("segments", T.ArrayType(S)), _f("is_dir", B),
])

BLOCK_REF = T.StructType([_f("path", S), _f("target_type", S), _f("target_name", S), _f("content", S)])
BLOCK_CHANGE = T.StructType([_f("block", BLOCK_REF), _f("new_content", S), _f("new_comment", S)])
CHANGES_PLAN = T.StructType([_f("id", S), _f("query", S), _f("changes", T.ArrayType(BLOCK_CHANGE))])

REVIEW = T.StructType([_f("plan_id", S), _f("result", B), _f("comment", S)])

# model output shapes (JSON keys exactly as emitted)
LOCATED_BLOCK = T.StructType([_f("block_type", S), _f("name", S)])
FILE_BLOCK_LIST = T.StructType([
    _f("files", T.ArrayType(T.StructType([_f("path", S), _f("blocks", T.ArrayType(LOCATED_BLOCK))]))),
])
LOCATION_OUTPUT = T.StructType([_f("Query", S), _f("BlockList", FILE_BLOCK_LIST)])
FILE_LIST = T.StructType([_f("paths", T.ArrayType(S))])
YES_OR_NO = T.StructType([_f("answer", B)])

REPAIR = T.StructType([_f("diff", S)])
REPAIR_OUTPUT = T.StructType([
    _f("Query", S),
    _f("FileRepairs", T.ArrayType(T.StructType([
        _f("File", S),
        _f("BlockRepairs", T.ArrayType(T.StructType([
            _f("Block", LOCATED_BLOCK), _f("BlockContent", S),
            _f("Repairs", T.ArrayType(T.StructType([_f("Sample", I), _f("Repair", REPAIR)]))),
        ]))),
    ]))),
])

DIRECTORY_SUMMARY = T.StructType([_f("purpose", S), _f("components", T.ArrayType(S)), _f("description", S)])
OVERALL_SUMMARY = T.StructType([
    _f("project_name", S), _f("purpose", S), _f("architecture", S), _f("key_components", T.ArrayType(S)),
    _f("technologies", T.ArrayType(S)), _f("entry_points", T.ArrayType(S)), _f("configuration", S),
    _f("env_vars", T.ArrayType(T.StructType([_f("name", S), _f("description", S)]))),
    _f("dependencies", T.ArrayType(S)), _f("notes", S),
])
REPO_SUMMARY = T.StructType([
    _f("summary", OVERALL_SUMMARY), _f("directory_summaries", T.MapType(S, DIRECTORY_SUMMARY)),
])

ACTION_PLAN = T.StructType([
    _f("investigate_steps", T.ArrayType(S)), _f("change_steps", T.ArrayType(S)),
])
INVESTIGATION_RESULT = T.StructType([
    _f("target_files", T.ArrayType(S)), _f("reference_files", T.ArrayType(S)), _f("result", S),
])
