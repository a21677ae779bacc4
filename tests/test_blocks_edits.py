"""Block index and edits: the reference's parser and applier cases."""

from pyspark.sql import functions as F

from quarry.operators import blocks as BK
from quarry.operators import edits as ED

GO = """package main

import "fmt"

// main prints
func main() {
\tfmt.Println("hi")
}

var x = 1
var y = 2

func (s *S) Method(a int) error { return nil }

var (
\tp, q = 1, 2
)
"""

HCL = '''variable "example" {
  default = "value"
}

resource "aws_instance" "example" {
  ami           = "ami-123456"
  instance_type = "t2.micro"
  tags = {
    Name = "x"
  }
}
'''


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_go_index(spark):
    funcs, vars_ = BK.go_index(_files(spark, [("m.go", GO)]))
    f = {r.name: (r.start_line, r.end_line) for r in funcs.collect()}
    assert f == {"main": (6, 8), "Method": (13, 13)}
    v = {r.name: r.start_line for r in vars_.collect()}
    assert v == {"x": 10, "y": 11, "p": 16, "q": 16}
    body = {r.name: r.content for r in funcs.collect()}["main"]
    assert body == 'func main() {\n\tfmt.Println("hi")\n}'


def test_hcl_index(spark):
    blocks, attrs = BK.hcl_index(_files(spark, [("t.tf", HCL)]))
    b = {(r.block_type, r.block_name): (r.start_line, r.end_line) for r in blocks.collect()}
    assert b == {("variable", "example"): (1, 3), ("resource", "aws_instance,example"): (5, 11)}
    a = {(r.block_name, r.name): r.value for r in attrs.collect()}
    assert a[("aws_instance,example", "ami")] == '"ami-123456"'
    assert ("aws_instance,example", "Name") not in a  # inside an object literal, not a block attribute
    assert a[("aws_instance,example", "tags")] == '{\nName="x"\n}'  # the value's tokens, over all its lines


def test_python_index(spark):
    rows = BK.python_index(_files(spark, [("a.py", "def foo():\n    pass\n\nx = 10\n"), ("b.py", "def (")])).collect()
    got = {(r.kind, r.name) for r in rows if r.error is None}
    assert got == {("function", "foo"), ("var", "x")}
    assert any(r.kind == "error" for r in rows)


def test_function_body_replace_and_comment(spark):
    files = _files(spark, [("m.go", GO)])
    funcs, _ = BK.go_index(files)
    edits = spark.createDataFrame([("m.go", "main", 'fmt.Println("bye")', "prints bye", 1)],
                                  "path string, target_name string, new_content string, new_comment string, seq int")
    sp = ED.function_body_splices(funcs, edits).unionByName(ED.comment_splices(funcs, edits))
    out = ED.splice(files, sp).first().content
    assert '// prints bye\nfunc main() {\n\tfmt.Println("bye")\n}' in out
    assert "// main prints" not in out


def test_hcl_attribute_set(spark):
    files = _files(spark, [("t.tf", HCL)])
    blocks, attrs = BK.hcl_index(files)
    sets = spark.createDataFrame([("t.tf", "aws_instance,example", "ami", "ami-9", 1)],
                                 "path string, block_name string, name string, value string, seq int")
    out = ED.splice(files, ED.hcl_attribute_splices(attrs, blocks, sets)).first().content
    assert out.splitlines()[5] == '  ami           = "ami-9"'
    assert out.count("\n") == HCL.count("\n")


def test_unsupported_edit_type(spark):
    df = spark.createDataFrame([("unsupported_file_type.py", "function"), ("a.go", "file"), ("a.go", "function")],
                               "path string, target_type string")
    got = [r.error for r in ED.validate(df).collect()]
    assert got == ["unsupported file type: unsupported_file_type.py",
                   "unsupported change type for go file: file", None]


def test_overlapping_edits_last_wins(spark):
    sp = spark.createDataFrame([("f", 2, 4, "a", 1), ("f", 2, 4, "b", 2), ("f", 3, 5, "c", 1), ("f", 4, 4, "d", 1)],
                               "path string, start int, stop int, new_text string, seq int")
    ok, conflicts = ED.resolve_overlaps(sp)
    assert sorted(r.new_text for r in ok.collect()) == ["b"]
    assert sorted((r.start, r.stop) for r in conflicts.collect()) == [(3, 5), (4, 4)]


def _one(spark, path, text):
    return _files(spark, [(path, text)])


def _body_edit(spark, text, name, new, comment=""):
    files = _one(spark, "m.go", text)
    funcs, _ = BK.go_index(files)
    edits = spark.createDataFrame([("m.go", name, new, comment, 1)],
                                  "path string, target_name string, new_content string, new_comment string, seq int")
    sp = ED.function_body_splices(funcs, edits).unionByName(ED.comment_splices(funcs, edits))
    return ED.splice(files, sp).first().content, ED.edit_errors(funcs, edits).collect()


def test_go_index_of_an_indented_file(spark):
    text = """
		package main

		import "fmt"

		func main() {
			fmt.Println("Hello, World!")
		}

		var x int
		var y = 2
	"""
    funcs, vars_ = BK.go_index(_one(spark, "m.go", text))
    assert [(r.name, r.start_line, r.end_line) for r in funcs.collect()] == [("main", 6, 8)]
    assert [(r.name, r.start_line, r.end_line) for r in vars_.orderBy("start_line").collect()] == [("x", 10, 10), ("y", 11, 11)]


def test_go_index_of_ordinary_layouts(spark):
    text = ("package p\n\nvar (\n\tcfg = Config{\n\t\tName: \"a\",\n\t\tPort: 1,\n\t}\n\tn = f(1,\n\t2)\n\tafter int\n)\n\n"
            "func raw() string {\n\treturn `\n}\n`\n}\n\nfunc ext(x int)\n\nconst c = 1\nfunc (r *R[T]) M[K any](f func() error) (map[string]int, error) { y := 1; return nil, nil }\n")
    funcs, vars_ = BK.go_index(_one(spark, "m.go", text))
    assert [(r.name, r.start_line, r.end_line) for r in funcs.orderBy("start").collect()] == [("raw", 13, 17), ("ext", 19, 19), ("M", 22, 22)]
    assert [(r.name, r.start_line) for r in vars_.orderBy("start_line").collect()] == [("cfg", 4), ("n", 8), ("after", 10)]
    assert [r.error for r in BK.unparsed(_one(spark, "m.go", "func f( {")).collect()] == ["brackets do not match"]


def test_function_edits_of_ordinary_layouts(spark):
    assert _body_edit(spark, "func One() int { return 1 }\n", "One", "return 2")[0] == "func One() int {\n\treturn 2\n}\n"
    got, _ = _body_edit(spark, "func F(\n\ta int,\n) (int, error) {\n\treturn a, nil\n}\n", "F", "\nreturn 0, nil\n")
    assert got == "func F(\n\ta int,\n) (int, error) {\n\treturn 0, nil\n}\n"
    got, errors = _body_edit(spark, "func ext(x int)\n", "ext", "return")
    assert got == "func ext(x int)\n" and errors[0].error == 'function "ext" has no body'
    assert _body_edit(spark, "func a() {}\n", "b", "return")[1][0].error == "function b not found"
    assert _body_edit(spark, "func a() {}\n", "a", "")[0] == "func a() {}\n"


def test_function_and_comment_update(spark):
    text = """
package main

import "fmt"

// greet receives a name and prints a greeting message.
func greet(name string) {
	fmt.Printf("Hello, %s!\\n", name)
}
"""
    got, _ = _body_edit(spark, text, "greet", 'fmt.Printf("Hi, %s! Welcome back.\\n", name)', "greet function greet with welcome message")
    assert got == """
package main

import "fmt"

// greet function greet with welcome message
func greet(name string) {
	fmt.Printf("Hi, %s! Welcome back.\\n", name)
}
"""


def test_whole_function_replaced_in_text(spark):
    text = "package main\n\nfunc SampleFunction() {\n\t// Sample function content\n}\n"
    new = "\nfunc SampleFunction() {\n\t// Updated function content\n}\n"
    edits = spark.createDataFrame([("m.go", "SampleFunction", new), ("n.go", "NonExistentFunction", new), ("o.go", "f", new)],
                                  "path string, target_name string, new_content string")
    rows = ED.replace_functions(_files(spark, [("m.go", text), ("n.go", text), ("o.go", "func f() {"), ("p.go", "x")]), edits)
    got = {r.path: (r.content, r.error) for r in rows.collect()}
    assert got == {"m.go": ("package main\n\n\nfunc SampleFunction() {\n\t// Updated function content\n}\n\n", None),
                   "n.go": (text, "function NonExistentFunction not found"),
                   "o.go": ("func f() {", "could not determine the end of function f"), "p.go": ("x", None)}


IAM = """resource "google_secret_manager_secret_iam_member" "example_sa_is_slack_token_secret_accessor" {
  project   = var.gcp_project_id
  member    = google_service_account.example_sa.member
  secret_id = google_secret_manager_secret.slack_token.secret_id
  role      = "roles/secretmanager.secretAccessor"
}
"""
BUCKET = """resource "google_storage_bucket" "unchanged_bucket" {
  name     = "unchanged-bucket"
  location = "US"
}
"""
INSTANCE = """resource "google_compute_instance" "%s" {
  name         = "example-instance"
  machine_type = "n1-standard-1"
  zone         = "us-central1-a"
}
"""


def test_hcl_attribute_values(spark):
    _, attrs = BK.hcl_index(_one(spark, "t.tf", "\n" + IAM))
    assert {r.name: r.value for r in attrs.collect()} == {
        "project": "var.gcp_project_id", "member": "google_service_account.example_sa.member",
        "secret_id": "google_secret_manager_secret.slack_token.secret_id", "role": '"roles/secretmanager.secretAccessor"'}


def test_hcl_attribute_update_keeps_the_layout(spark):
    files = _one(spark, "t.tf", IAM + "\n" + BUCKET)
    blocks, attrs = BK.hcl_index(files)
    sets = spark.createDataFrame([("t.tf", "google_secret_manager_secret_iam_member,example_sa_is_slack_token_secret_accessor", "role",
                                   "roles/secretmanager.secretAdmin", 1)], "path string, block_name string, name string, value string, seq int")
    out = ED.splice(files, ED.hcl_attribute_splices(attrs, blocks, sets)).first().content
    assert out == IAM.replace("secretAccessor\"", "secretAdmin\"") + "\n" + BUCKET


def test_hcl_append_block(spark):
    body = '  name         = "example-instance"\n  machine_type = "n1-standard-1"\n  zone         = "us-central1-a"\n'
    add = spark.createDataFrame([("t.tf", 1, "resource", ["google_compute_instance", "example_instance"], body)],
                                "path string, seq int, kind string, labels array<string>, body string")
    add = add.select("path", "seq", ED.block_text(F.col("kind"), F.col("labels"), F.col("body")).alias("text"))
    assert ED.append_blocks(_one(spark, "t.tf", BUCKET), add).first().content == (
        BUCKET + 'resource "google_compute_instance" "example_instance" {\n' + body + " }\n")


def test_hcl_rename(spark):
    files = _one(spark, "t.tf", INSTANCE % "example_instance" + "\n" + BUCKET)
    blocks, _ = BK.hcl_index(files)
    ren = spark.createDataFrame([("t.tf", "resource", "google_compute_instance,example_instance", "new_example_instance", 1)],
                                "path string, block_type string, block_name string, new_name string, seq int")
    assert ED.splice(files, ED.hcl_rename_splices(blocks, ren)).first().content == INSTANCE % "new_example_instance" + "\n" + BUCKET


def test_hcl_block_content(spark):
    blocks, _ = BK.hcl_index(_one(spark, "t.tf", '\nresource "example" "test" {\n  name = "test-resource"\n}\n'))
    req = spark.createDataFrame([("t.tf", "test"), ("t.tf", "nonexistent")], "path string, name string")
    got = {r.name: (r.content, r.error) for r in BK.resource_content(blocks, req).collect()}
    assert got == {"test": ('\nname = "test-resource"\n', None), "nonexistent": (None, "resource block not found: nonexistent")}


def _block_edit(spark, text, kind, name, new):
    files = _one(spark, "t.tf", text)
    blocks, _ = BK.hcl_index(files)
    edits = spark.createDataFrame([("t.tf", kind, name, new, 1)],
                                  "path string, target_type string, target_name string, new_content string, seq int")
    return ED.splice(files, ED.hcl_block_splices(blocks, edits)).first().content


def test_hcl_block_update(spark):
    bucket = BUCKET.replace("unchanged", "example")
    new = '\nname     = "new-example-bucket"\nlocation = "EU"\n'
    want = 'resource "google_storage_bucket" "example_bucket" {\n  name     = "new-example-bucket"\n  location = "EU"\n}\n'
    rest = "\n" + INSTANCE % "unchanged_instance"
    assert _block_edit(spark, bucket + rest, "resource", "google_storage_bucket,example_bucket", new) == want + rest
    note = '// This is a comment\nresource "example" "test" {\n  name = "%s"\n}\n'
    assert _block_edit(spark, note % "old_name", "resource", "example,test", '\nname = "new_name"\n') == note % "new_name"
    module = 'module "test" {\n  source%s= "./mod/test"\n  members = [\n    "user1",\n    "user2",\n%s  ]\n}\n'
    new = '\n  source  = "./mod/test"\n  members = [\n    "user1",\n    "user2",\n    "user3",\n  ]\n'
    assert _block_edit(spark, module % ("  ", ""), "module", "test", new) == module % (" ", '    "user3",\n')
    assert _block_edit(spark, bucket, "resource", "google_storage_bucket,example_bucket", "") == bucket


def test_hcl_index_of_ordinary_layouts(spark):
    text = ('variable "x" { default = 1 }\nresource "a" "b" { # note\n  t = <<EOT\n}\nEOT\n  l = ["p", "q"]\n  s = "${f("}")}"\n}\n')
    blocks, attrs = BK.hcl_index(_one(spark, "t.tf", text))
    assert [(r.block_type, r.block_name, r.start_line, r.end_line) for r in blocks.orderBy("start").collect()] == [("variable", "x", 1, 1), ("resource", "a,b", 2, 8)]
    assert {r.name: r.value for r in attrs.collect()} == {"default": "1", "t": "<<EOT\n}\nEOT", "l": '["p","q"]', "s": '"${f("}")}"'}


def test_go_index_shuffles_tokens_once(spark):
    """One exchange by path deals the tokens out; functions, variables and errors come from the same windows."""
    files = _files(spark, [("m.go", GO)]).repartition(4)
    plan = BK._go_rows(files, "path", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and plan.count("ArrowEvalPython") == 1 and "Scan parquet" not in plan


def test_go_index_of_odd_files(spark):
    rows = [("a.go", "var (\n\ta, b = 1, 2\n)\nfunc f() {}\n// x\n// y\nfunc g() {\n\tvar q int\n}\n"), ("b.go", "func f( {"), ("c.go", "func f() }"), ("d.go", "func f(]{}"),
            ("e.go", "func () {}\nvar x = 1"), ("f.go", ""), ("g.go", None), ("h.go", "// only a note"), ("i.go", "var s = \"}\" // {\nvar t = '('\n"), ("n.py", "func f() {}")]
    index = BK._go_rows(_files(spark, rows), "path", "content")
    got = sorted((r.path, r.kind, r.name or "", r.start_line or 0, r.doc_start or 0) for r in index.collect())
    assert got == [("a.go", "function", "f", 4, 4), ("a.go", "function", "g", 7, 5), ("a.go", "var", "a", 2, 0), ("a.go", "var", "b", 2, 0), ("a.go", "var", "q", 8, 0),
                   ("b.go", "error", "", 0, 0), ("c.go", "error", "", 0, 0), ("d.go", "error", "", 0, 0), ("e.go", "error", "", 0, 0), ("i.go", "var", "s", 1, 0), ("i.go", "var", "t", 2, 0)]


def test_block_match_reads_an_index_that_is_kept(spark):
    """The candidates are read three times; their index is worked out once."""
    files = _files(spark, [("m.go", GO)])
    req = spark.createDataFrame([("1", "m.go", "function", "main"), ("2", "m.go", "file", ""), ("3", "m.go", "function", "none")],
                                "req_id string, path string, target_type string, target_name string")
    out = BK.block_match(req, BK.block_candidates(files))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.req_id, r.target_name, r.start_line) for r in out.collect()) == [("1", "main", 6), ("2", "Method", 13), ("2", "main", 6)]
