"""Block index over code files (G1-G7): functions, variables, HCL blocks and
attributes with 1-based line ranges and character offsets, for a whole files table.

A small lexer (``functions.source_code``) tells the tokens of a file apart where the file lies.  From there on (Go: after
one shuffle of the tokens by path) the index is windows and groups over token rows: running sums give every token its level, the next
bracket of a level is an open one's mate, and declarations, specs, blocks and attributes are short groups
of tokens of one level.  No window or group exceeds one file; texts are read again only to cut out what
was found.  A file whose brackets do not match gives one ``error`` row instead of guesses.

* Go: top-level functions with their body's brace range (any layout: one line,
  signatures over several lines, methods, type parameters); variables of ``var``
  declarations and groups, inside functions too; ``:=`` and const are not vars.
* HCL: blocks at any level (one-line blocks too) and the attributes of their bodies;
  a value is its tokens without the blanks between them, over all its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import source_code as SC
from quarry.session import scratch_path

HCL_EXTENSIONS = (".hcl", ".tf")

# One row per thing found; spans are character offsets, ends exclusive.
INDEX = (
    "path string, kind string, name string, labels array<string>, level int, block_start int, block_name string, start_line int, end_line int, "
    "start int, stop int, body_from int, body_to int, doc_start int, doc_from int, label_from int, label_to int, value string, content string"
)
_COLUMNS = [c.strip().split(" ")[0] for c in INDEX.split(",")]


def line_table(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, line_no, text)`` with 1-based line numbers."""
    f = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return f.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "text")


_TOKEN = "path string, kind string, text string, pos int, end int, line int, line_from int, lead string, alone boolean"
_MATES = "{([", "})]"
#: Characters after which a line's end does not end a Go statement.
_GO_CONTINUES = tuple(",=+-*/%&|^<>!(.:")


def tokens(files: DataFrame, extensions: tuple[str, ...], split, *, path: str = "path", content: str = "content") -> DataFrame:
    """The tokens (columns ``_TOKEN``) of the files with these extensions, by a small lexer where the file lies."""
    p = F.col(path)
    mine = F.lit(False)
    for x in extensions:
        mine = mine | p.endswith(x)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = [(name, *t) for name, src in zip(pdf["path"], pdf["content"]) for t in split(src or "")]
            yield pd.DataFrame(rows, columns=["path", *SC.Token._fields])

    return files.filter(mine).select(p.alias("path"), F.col(content).alias("content")).mapInPandas(run, _TOKEN)


def _nested(found: DataFrame) -> DataFrame:
    """Tokens with ``level`` (open brackets around them; a bracket has the level of what is around
    it), ``mate`` (of an open bracket: where its closing one stands), the token before, and ``broken``: brackets of
    the file do not match."""
    along = Window.partitionBy("path").orderBy("pos")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    is_open, is_close = F.col("kind") == SC.OPEN, F.col("kind") == SC.CLOSE
    prev = F.last(F.when(F.col("kind") != SC.COMMENT, F.struct("kind", "text")), ignorenulls=True).over(past)
    t = found.withColumns({"after": F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(along), "prev": prev})
    t = t.withColumns({"level": F.col("after") - is_open.cast("int"), "prev_kind": F.col("prev.kind"), "prev_text": F.col("prev.text")}).drop("prev")
    # of one level the bracket that follows an open one is its mate
    ahead = Window.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(is_open | is_close, F.struct("kind", "text", "pos", "line")), ignorenulls=True).over(ahead)
    fits = (F.col("nxt.kind") == SC.CLOSE) & (F.col("nxt.text") == F.translate("text", *_MATES))
    t = t.withColumn("nxt", nxt).withColumn("mate", F.when(is_open & fits, F.struct("nxt.pos", "nxt.line"))).drop("nxt")
    bad = (is_open & F.col("mate").isNull()) | (F.col("after") < 0)
    t = t.withColumn("broken", F.max(bad).over(Window.partitionBy("path"))).drop("after")
    # every part of the index starts from here: the lexer and these windows run once
    out = scratch_path(found.sparkSession, f"tokens-{uuid.uuid4().hex}")
    t.write.parquet(out)
    return found.sparkSession.read.schema(t.schema).parquet(out)


def _regions(t: DataFrame) -> tuple[DataFrame, Window]:
    """Each token beside the others of its own level, and every open bracket once more (``mark``) as the
    beginning of what it encloses; with the window that runs along a level of a file."""
    opens = F.array(F.lit(False), F.lit(True))
    t = t.withColumn("mark", F.explode(F.when(F.col("kind") == SC.OPEN, opens).otherwise(F.array(F.lit(False)))))
    return t.withColumn("region", F.col("level") + F.col("mark").cast("int")), Window.partitionBy("path", "region").orderBy("pos", "mark")


def _row(kind: str, **cols) -> list[Column]:
    """The columns of ``INDEX``, null where not given."""
    kinds = dict(c.strip().split(" ") for c in INDEX.split(","))
    given = {"path": F.col("path"), "kind": F.lit(kind), **cols}
    return [given[c].cast(kinds[c]).alias(c) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS]


_GO_TOKEN = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "text")] + [
    T.StructField(c, T.IntegerType()) for c in ("pos", "end", "line", "doc_line", "doc_from")])


@F.arrow_udf(T.ArrayType(_GO_TOKEN))
def _go_tokens(texts):
    import pyarrow as pa
    found, counts = [], [0]
    for src in texts.to_pylist():
        found.extend(SC.go_tokens(src or ""))
        counts.append(len(found))
    kinds = [pa.string()] * 2 + [pa.int32()] * 5
    columns = [pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 7, kinds)]
    items = pa.StructArray.from_arrays(columns, names=_GO_TOKEN.names)
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)


def _go_marked(src: DataFrame) -> DataFrame:
    """The tokens of files ``(path, _src)`` with ``level`` (open brackets around them; a bracket has the level of
    what is around it), ``broken`` (brackets of the file do not match), ``decl`` (number of the top-level declaration) and
    ``is_name`` (a name of a ``var`` declaration: those that stand first, parted by commas, in each spec).

    Two orders of a file's tokens give all of it: by place, and by place along each level.  Along a level every
    open bracket stands once more (``mark``) as the beginning of what it encloses."""
    found = src.select("path", F.posexplode(_go_tokens("_src")).alias("at", "t"), "_src")
    # the text stays with a file's first token
    found = found.select("path", "t.*", F.when(F.col("at") == 0, F.col("_src")).alias("_src"))
    along = Window.partitionBy("path").orderBy("pos")
    is_open, is_close, word = F.col("kind") == SC.OPEN, F.col("kind") == SC.CLOSE, F.col("kind") == SC.WORD
    delta = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    t = found.withColumns({"after": F.sum(delta).over(along), "prev_kind": F.lag("kind").over(along), "prev_text": F.lag("text").over(along)})
    t = t.withColumn("level", F.col("after") - is_open.cast("int"))
    fresh_line = F.col("prev_kind").isNull() | (F.col("prev_kind") == SC.NEWLINE)
    starts = (F.col("text") == "func") & word & (F.col("level") == 0) & (fresh_line | F.col("prev_text").isin(";", "}"))
    is_var = word & (F.col("text") == "var") & (fresh_line | F.col("prev_text").isin(";", "{", "}"))
    t = t.withColumns({"decl": F.sum(starts.cast("int")).over(along), "after_var": F.coalesce(F.lag(is_var).over(along), F.lit(False))})
    r, region = _regions(t)
    before = region.rowsBetween(Window.unboundedPreceding, -1)
    plain = ~F.col("mark")
    text = F.when(plain, F.col("text")).otherwise(F.lit(""))
    r = r.withColumns({
        "grouped": F.last(F.when(F.col("mark"), F.col("after_var") & (F.col("text") == "(")), ignorenulls=True).over(region),
        "last_text": F.last(F.when(F.col("mark") | (F.col("kind") != SC.NEWLINE), text), ignorenulls=True).over(before),
        "last_kind": F.lag(F.when(F.col("mark"), "m").otherwise(F.col("kind"))).over(region),
        # what would close the bracket before, of the same level: nothing after a closing one
        "closer": F.last(F.when(plain & is_open, F.translate("text", *_MATES)).when(plain & is_close, F.lit("")), ignorenulls=True).over(before),
    }).filter(plain)
    wrong = (is_close & (F.coalesce("closer", F.lit("")) != F.col("text"))) | (F.col("after") < 0)
    whole = Window.partitionBy("path")
    fresh = F.col("last_text").isin("", ";") | ((F.col("last_kind") == SC.NEWLINE) & ~F.substring("last_text", -1, 1).isin(*_GO_CONTINUES))
    in_group = F.coalesce("grouped", F.lit(False)) & (F.col("kind") != SC.NEWLINE) & (F.col("text") != ";") & fresh
    r = r.withColumns({"spec": (F.col("after_var") & (F.col("text") != "(")) | in_group, "broken": F.max(wrong).over(whole) | (F.sum(delta).over(whole) != 0)})
    fine = (word & (F.col("spec") | (F.col("prev_text") == ","))) | ((F.col("text") == ",") & (F.col("prev_kind") == SC.WORD))
    # the tokens of a spec up to the first that is neither name nor comma lie side by side on its level
    level = Window.partitionBy("path", "region").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    off = (~fine).cast("int")
    r = r.withColumn("off", F.sum(off).over(level))
    r = r.withColumn("off_at_spec", F.last(F.when(F.col("spec"), F.col("off") - off), ignorenulls=True).over(level))
    return r.withColumn("is_name", F.coalesce(word & (F.col("off") == F.col("off_at_spec")), F.lit(False)))


def _go_function(d: DataFrame) -> DataFrame:
    """The function of each declaration from its top-level tokens (``all``): few, what brackets enclose is deeper."""
    d = d.withColumn("h", F.filter("all", lambda x: x["kind"] != SC.NEWLINE))
    at = lambda i: F.try_element_at(F.col("h"), i)
    # func [ "(" receiver ")" ] name [ "[" type parameters "]" ] "(" parameters ")"
    d = d.withColumn("i", F.when(at(F.lit(2))["text"] == "(", 4).otherwise(2))
    d = d.withColumn("name", at(F.col("i")))
    d = d.withColumn("i", F.col("i") + 1)
    for bracket in "[(":
        d = d.withColumn("i", F.col("i") + F.when(at(F.col("i"))["text"] == bracket, 2).otherwise(0))
    d = d.withColumn("head_end", at(F.col("i") - 1)["end"])
    ends = lambda x: (x["kind"] == SC.NEWLINE) | ((x["text"] == "{") & ~F.coalesce(x["prev_text"], F.lit("")).isin("interface", "struct"))
    d = d.withColumn("rest", F.filter("all", lambda x: x["pos"] >= F.col("head_end")))
    d = d.withColumn("stop_at", F.try_element_at(F.filter("rest", ends), F.lit(1)))
    d = d.withColumn("shown", F.filter("h", lambda x: F.col("stop_at").isNull() | (x["pos"] < F.col("stop_at.pos"))))
    # of one level the bracket that follows an open one is its mate
    mate = F.try_element_at(F.filter("rest", lambda x: (x["kind"] == SC.CLOSE) & (x["pos"] > F.col("stop_at.pos"))), F.lit(1))
    d = d.withColumn("mate", F.when(F.col("stop_at.text") == "{", mate))
    body, func, last = F.col("mate").isNotNull(), F.try_element_at("all", F.lit(1)), F.try_element_at("shown", F.lit(-1))
    start, stop = func["pos"], F.when(body, F.col("mate.end")).otherwise(last["end"])
    return d.withColumn("function", F.when(F.size("all") > 0, F.struct(*_row(
        "function", name=F.col("name.text"), start_line=func["line"], end_line=F.when(body, F.col("mate.line")).otherwise(last["line"]), start=start, stop=stop,
        body_from=F.when(body, F.col("stop_at.end")), body_to=F.when(body, F.col("mate.pos")), doc_start=func["doc_line"], doc_from=func["doc_from"],
        content=F.substring("_src", start + 1, stop - start)))))


def _hcl_items(t: DataFrame) -> DataFrame:
    """Blocks and attributes: the items of bodies, each with its own level's tokens (``item``) in order.  A bracket
    whose line has an ``=`` before it opens a value, and what values enclose are no items."""
    along = Window.partitionBy("path").orderBy("pos")
    ahead = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"next_kind": F.lead("kind").over(along), "next_end": F.lead("end").over(along),
                       "line_break": F.last(F.when(F.col("kind") == SC.NEWLINE, F.col("pos")), ignorenulls=True).over(ahead)})
    r, region = _regions(t)
    before = region.rowsBetween(Window.unboundedPreceding, -1)
    is_open, is_close, plain = F.col("kind") == SC.OPEN, F.col("kind") == SC.CLOSE, ~F.col("mark")
    pos_if = lambda c: F.coalesce(F.max(F.when(c, F.col("pos"))).over(before), F.lit(-1))
    value = (pos_if(plain & (F.col("text") == "=")) > pos_if(F.col("mark") | (F.col("kind") == SC.NEWLINE))) | F.col("text").isin("(", "[")
    r = r.withColumn("value", is_open & value)
    r = r.withColumns({
        "closes_value": is_close & F.coalesce(F.last(F.when(plain & is_open, F.col("value")), ignorenulls=True).over(before), F.lit(False)),
        "owner": F.last(F.when(F.col("mark"), F.col("pos")), ignorenulls=True).over(region),
    })
    inside = F.sum(F.when(plain & F.col("value"), 1).when(plain & F.col("closes_value"), -1).otherwise(0)).over(Window.partitionBy("path").orderBy("pos", "mark"))
    r = r.withColumn("inside", inside - (plain & F.col("value")).cast("int"))
    r = r.filter(F.col("mark") | (F.col("inside") == 0))
    ended = F.lag(F.when(F.col("mark") | (F.col("kind") == SC.NEWLINE) | (is_close & ~F.col("closes_value")), True).otherwise(False)).over(region)
    starts = plain & (F.col("kind") != SC.NEWLINE) & ~(is_close & ~F.col("closes_value")) & F.coalesce(ended, F.lit(True))
    r = r.withColumn("start", F.last(F.when(starts, F.col("pos")), ignorenulls=True).over(region))
    item = F.struct("pos", "end", "kind", "text", "line", F.col("mate.pos").alias("mate"), F.col("mate.line").alias("mate_line"), "next_kind", "next_end", "line_break")
    own = r.filter(plain & (F.col("kind") != SC.NEWLINE) & (F.col("start") >= F.coalesce("owner", F.lit(-1))))
    # a block's closing brace belongs to the item that it closes
    return own.groupBy("path", "region", "start").agg(F.max("owner").alias("owner"), F.sort_array(F.collect_list(item)).alias("item"))


def _hcl_rows(t: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the index, paths that hold anything that is neither block nor attribute)."""
    items = _hcl_items(t)
    first, second = F.element_at("item", 1), F.try_element_at("item", F.lit(2))
    brace = F.try_element_at(F.filter("item", lambda x: x["text"] == "{"), F.lit(1))
    items = items.withColumns({"brace": brace, "is_attr": F.coalesce(second["text"] == "=", F.lit(False))})
    labels = F.filter(F.slice("item", 2, F.size("item")), lambda x: x["pos"] < F.col("brace.pos"))
    items = items.withColumn("labels", F.when(~F.col("is_attr") & F.col("brace").isNotNull(), labels))
    block = ~F.col("is_attr") & F.col("brace").isNotNull() & F.forall("labels", lambda x: x["kind"].isin(SC.WORD, SC.STRING)) & (F.element_at("item", -1)["pos"] == F.col("brace.mate"))
    items = items.withColumn("is_block", F.coalesce(block & (first["kind"] == SC.WORD), F.lit(False)))
    wrong = items.filter(~(F.col("is_block") | (F.col("is_attr") & (first["kind"] == SC.WORD)))).select("path").distinct()
    named = F.transform("labels", lambda x: F.when(x["kind"] == SC.STRING, F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2)).otherwise(x["text"]))
    inner = F.transform("labels", lambda x: F.when(x["kind"] == SC.STRING, F.struct((x["pos"] + 1).alias("a"), (x["end"] - 1).alias("b"))).otherwise(F.struct(x["pos"].alias("a"), x["end"].alias("b"))))
    blocks = items.filter("is_block").select(
        "path", F.col("brace.pos").alias("at"), first["text"].alias("type"), named.alias("labels"), F.try_element_at(inner, F.lit(2)).alias("second"), F.col("region").alias("level"),
        first["line"].alias("line"), F.col("start"), F.col("brace.end").alias("body_from"), F.col("brace.mate").alias("body_to"), F.col("brace.mate_line").alias("end_line"),
        F.when(F.col("brace.next_kind") == SC.NEWLINE, F.col("brace.next_end")).otherwise(F.col("brace.end")).alias("text_from"),
        F.coalesce(F.col("brace.line_break") < F.col("brace.mate"), F.lit(False)).alias("lines"))
    src = files.withColumnRenamed("content", "_src")
    cut = lambda a, b: F.substring("_src", F.col(a) + 1, F.col(b) - F.col(a))
    whole = F.regexp_replace(cut("text_from", "body_to"), r"\s+$", "")

    @F.pandas_udf("string")
    def formatted(body):
        return body.map(lambda b: SC.format_hcl(b, 0))

    block_rows = blocks.join(src, "path").select(*_row(
        "block", name=F.col("type"), labels=F.col("labels"), level=F.col("level"), block_name=F.array_join("labels", ","), start_line=F.col("line"), end_line=F.col("end_line"),
        start=F.col("start"), stop=F.col("body_to") + 1, body_from=F.col("body_from"), body_to=F.col("body_to"), label_from=F.col("second.a"), label_to=F.col("second.b"),
        value=formatted(cut("body_from", "body_to")), content=F.when(F.col("lines"), whole).otherwise(F.regexp_replace(whole, r"^\s+", ""))))
    # a value is its tokens in turn, also those that its brackets enclose
    attrs = items.filter("is_attr AND owner IS NOT NULL").select(
        "path", "owner", first["text"].alias("name"), first["line"].alias("line"), F.coalesce(F.try_element_at("item", F.lit(3))["pos"], second["end"]).alias("from"),
        F.greatest(F.element_at("item", -1)["end"], second["end"]).alias("to"))
    along = Window.partitionBy("path").orderBy("pos", F.desc("attr"))
    spans = attrs.select("path", F.col("from").alias("pos"), F.lit(True).alias("attr"), F.struct("from", "to").alias("span"))
    words = t.select("path", "pos", F.lit(False).alias("attr"), F.lit(None).cast("struct<from:int,to:int>").alias("span"), "text", "lead")
    mixed = spans.withColumn("text", F.lit(None).cast("string")).withColumn("lead", F.lit(None).cast("string")).unionByName(words)
    mixed = mixed.withColumn("mine", F.last("span", ignorenulls=True).over(along)).filter((~F.col("attr")) & (F.col("pos") < F.col("mine.to")))
    said = F.when(F.col("pos") == F.col("mine.from"), F.col("text")).otherwise(F.concat("lead", "text"))
    values = mixed.groupBy("path", F.col("mine.from").alias("from")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x["t"]), "").alias("value"))
    owners = blocks.select("path", F.col("at").alias("owner"), F.col("line").alias("block_line"), F.array_join("labels", ",").alias("block_name"))
    line = F.col("line")
    attr_rows = attrs.join(owners, ["path", "owner"]).join(values, ["path", "from"], "left").select(*_row(
        "attribute", name=F.col("name"), block_start=F.col("block_line"), block_name=F.col("block_name"), start_line=line, end_line=line, start=F.col("from"), stop=F.col("to"),
        value=F.coalesce("value", F.lit(""))))
    return block_rows.unionByName(attr_rows), wrong


def code_index(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """All functions, vars, blocks, attributes and errors of the .go, .hcl and .tf files
    (columns ``INDEX``).  Null content counts as empty."""
    return _go_rows(files, path, content).unionByName(_hcl_all(files, path, content))


def _errors(paths: DataFrame, why: str) -> DataFrame:
    return paths.select(*_row("error", content=F.lit(why)))


def _go_rows(files: DataFrame, path: str, content: str) -> DataFrame:
    """The tokens are dealt out by path once; everything after, texts too, stays where they lie."""
    src = files.filter(F.col(path).endswith(".go")).select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("_src"))
    t = _go_marked(src)
    top = (F.col("level") == 0) & (F.col("decl") > 0)
    item = F.struct("pos", "end", "kind", "text", "prev_text", "line", "doc_line", "doc_from")
    name = F.struct("pos", "end", "text", "line")
    d = t.filter(F.col("broken") | top | F.col("is_name") | F.col("_src").isNotNull()).groupBy(
        "path", "broken", F.when(~F.col("broken"), F.col("decl")).alias("decl")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("broken") & top, item))).alias("all"),
        F.collect_list(F.when(~F.col("broken") & F.col("is_name"), name)).alias("names"), F.max("_src").alias("_src"))
    whole = Window.partitionBy("path")
    d = _go_function(d.withColumn("_src", F.max("_src").over(whole)))
    # a declaration without a name is no Go: the whole file is reported
    nameless = F.max(F.col("function").isNotNull() & (F.coalesce(F.col("name.kind"), F.lit("")) != SC.WORD)).over(whole)
    d = d.withColumn("bad", F.col("broken") | nameless).withColumn("first", F.row_number().over(whole.orderBy("decl")) == 1)
    variables = F.transform("names", lambda x: F.struct(*_row(
        "var", name=x["text"], start_line=x["line"], end_line=x["line"], start=x["pos"], stop=x["end"], content=x["text"])))
    error = F.when(F.col("first"), F.array(F.struct(*_row("error", content=F.lit("brackets do not match")))))
    return d.select(F.inline(F.when(F.col("bad"), error).otherwise(F.array_compact(F.concat(F.array("function"), variables)))))


def _hcl_all(files: DataFrame, path: str, content: str) -> DataFrame:
    t = _nested(tokens(files, HCL_EXTENSIONS, SC.hcl_tokens, path=path, content=content)).filter(F.col("kind") != SC.COMMENT)
    src = files.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    rows, wrong = _hcl_rows(t.filter("NOT broken"), src)
    bad = t.filter("broken").select("path").distinct().union(wrong).distinct()
    return rows.join(bad, "path", "left_anti").unionByName(_errors(bad, "not blocks and attributes, or brackets do not match"))


def _kept(index: DataFrame) -> DataFrame:
    """The rows of an index, computed once and read by everything that follows."""
    out = scratch_path(index.sparkSession, f"index-{uuid.uuid4().hex}")
    index.write.parquet(out)
    return index.sparkSession.read.schema(index.schema).parquet(out)


def go_index(files: DataFrame, *, path: str = "path", content: str = "content",
             index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(functions, vars)``: functions ``path, name, start_line, end_line, content,
    doc_start`` (first line of the ``//`` comment run directly above, or the
    declaration's line) with offsets ``start, stop, body_from, body_to, doc_from`` (no
    body: null); vars ``path, name, start_line, end_line, content`` (content = name)."""
    ix = _kept(_go_rows(files, path, content)) if index is None else index
    funcs = ix.filter("kind = 'function'").select(
        "path", "name", "start_line", "end_line", "content", "doc_start", "start", "stop", "body_from", "body_to", "doc_from")
    return funcs, ix.filter("kind = 'var'").select("path", "name", "start_line", "end_line", "content")


def hcl_index(files: DataFrame, *, path: str = "path", content: str = "content",
              index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(blocks, attributes)``.

    blocks: ``path, block_type, labels, block_name, level, start_line, end_line, content``
    (the raw lines of the body) and ``formatted`` (the body at the left margin), with
    offsets ``start, stop, body_from, body_to, label_from, label_to`` (of the second label);
    attributes: ``path, block_name, block_start, name, value, line_no`` and the value's
    offsets ``start, stop``."""
    ix = _kept(_hcl_all(files, path, content)) if index is None else index
    blocks = ix.filter("kind = 'block'").select(
        "path", F.col("name").alias("block_type"), "labels", "block_name", "level", "start_line", "end_line", "content",
        F.col("value").alias("formatted"), "start", "stop", "body_from", "body_to", "label_from", "label_to")
    attrs = ix.filter("kind = 'attribute'").select(
        "path", "block_name", "block_start", "name", "value", F.col("start_line").alias("line_no"), "start", "stop")
    return blocks, attrs


def unparsed(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Code files that the scanners cannot read, with the reason (reported, not guessed)."""
    return code_index(files, path=path, content=content).filter("kind = 'error'").select("path", F.col("content").alias("error"))


# --------------------------------------------------------------------------- Python

PY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("error", T.StringType()),
])


def python_index(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Python functions (``def`` at any depth, not async) and plain-name
    assignment targets, with line ranges, via the standard ``ast`` module inside
    Arrow batches; a file that fails to parse yields one ``error`` row."""
    import ast

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for p, src in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(src or "")
                except Exception as e:  # noqa: BLE001 - one file never fails the job
                    out.append((p, "error", None, None, None, f"{type(e).__name__}: {getattr(e, 'msg', e)}"))
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.FunctionDef):
                        out.append((p, "function", node.name, node.lineno, node.end_lineno, None))
                    elif isinstance(node, ast.Assign):
                        for tgt in node.targets:
                            if isinstance(tgt, ast.Name):
                                out.append((p, "var", tgt.id, tgt.lineno, tgt.end_lineno, None))
            yield pd.DataFrame(out, columns=PY_SCHEMA.names)

    f = files.filter(F.col(path).endswith(".py")).select(F.col(path).alias("path"), F.col(content).alias("content"))
    return f.mapInPandas(run, PY_SCHEMA)


# --------------------------------------------------------------------------- candidates, lookup, match


def block_candidates(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Candidate blocks per file (G4): Go functions, HCL blocks (name = labels
    joined by ``,``), any other file as one ``file`` block.  Code files that cannot be
    read have none, as the reference skips unparsable files."""
    found = code_index(files, path=path, content=content).filter("kind IN ('function', 'block')").select(
        "path", F.when(F.col("kind") == "function", F.lit("function")).otherwise(F.col("name")).alias("target_type"),
        F.when(F.col("kind") == "function", F.col("name")).otherwise(F.col("block_name")).alias("target_name"),
        "start_line", "end_line")
    p = F.col(path)
    other = files.filter(~(p.endswith(".go") | p.endswith(".hcl") | p.endswith(".tf"))).select(
        p.alias("path"), F.lit("file").alias("target_type"), p.alias("target_name"),
        F.lit(1).alias("start_line"), F.size(F.split(F.col(content), "\n")).alias("end_line"))
    return found.unionByName(other)


def resource_content(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """The formatted body of the first top-level ``resource`` block with the requested
    second label (G5): ``path, name, content, error``; ``requests``: ``path, name``."""
    own = blocks.filter("block_type = 'resource' AND level = 0 AND size(labels) > 1").select(
        "path", F.col("labels")[1].alias("name"), "start", "formatted")
    first = own.groupBy("path", "name").agg(F.min_by("formatted", "start").alias("__body"))
    return requests.join(first, ["path", "name"], "left").select(
        "path", "name", F.concat(F.lit("\n"), "__body", F.lit("\n")).alias("content"),
        F.when(F.col("__body").isNull(), F.concat(F.lit("resource block not found: "), "name")).alias("error"))


def block_lookup(index: DataFrame, requests: DataFrame) -> DataFrame:
    """Index rows for requested ``(path, target_type, target_name)``; requests
    without a match come back with ``found = false`` (the reference errors)."""
    m = index.withColumn("found", F.lit(True))
    return requests.join(m, ["path", "target_type", "target_name"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def block_match(requested: DataFrame, candidates: DataFrame, *, req_id: str = "req_id") -> DataFrame:
    """Match requested blocks to candidates (G6): same path, type and name, first
    match only; a request of type ``file`` matches every candidate of its path;
    unmatched requests are dropped."""
    candidates = _kept(candidates)  # read three times below
    exact = requested.filter(F.col("target_type") != "file").join(
        candidates, ["path", "target_type", "target_name"]).groupBy(req_id, "path", "target_type", "target_name").agg(
        F.min("start_line").alias("start_line"))
    exact = exact.join(candidates, ["path", "target_type", "target_name", "start_line"]).select(
        req_id, "path", "target_type", "target_name", "start_line", "end_line")
    whole = requested.filter(F.col("target_type") == "file").select(req_id, "path").join(candidates, "path").select(
        req_id, "path", "target_type", "target_name", "start_line", "end_line")
    return exact.unionByName(whole)


def located_blocks(located: DataFrame, *, json_col: str = "json") -> DataFrame:
    """Flatten the locator's JSON output to ``query, path, block_type, name``."""
    from quarry.schemas import LOCATION_OUTPUT

    j = located.select(F.from_json(json_col, LOCATION_OUTPUT).alias("j"))
    files = j.select(F.col("j.Query").alias("query"), F.explode("j.BlockList.files").alias("f"))
    return files.select("query", F.col("f.path").alias("path"), F.explode("f.blocks").alias("b")).select(
        "query", "path", F.col("b.block_type").alias("block_type"), F.col("b.name").alias("name"))
