"""Templates of the Go and HCL files derived from ``part`` and ``supplier``, with the
index entries that each holds by construction (written out by hand, not computed).

``<k>`` is the key, ``<v>`` a value of the row.  A Go file is ``pre + doc + decl + body +
rest``: the function's doc comment, its declaration up to the brace, its body, and what
follows from the closing brace.  An HCL file is ``pre + head + body + rest``, the second
and third being the ``resource "supplier"`` block's header with its brace and its body.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Go:
    pre: str
    doc: str
    decl: str
    body: str
    rest: str
    func: tuple[int, int]  # lines of the function
    vars: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return self.pre + self.doc + self.decl + self.body + self.rest


GO = (
    Go("package p\n\n", "", "func F<k>() int {", "\n\treturn <v>\n", "}\n\nvar V<k> = 1\n", (3, 5), (("V<k>", 7),)),
    Go("package p\n\n", "", "func F<k>() int {", " return <v> ", "}\n\nvar V<k>, W<k> = 1, 2\n", (3, 3), (("V<k>", 5), ("W<k>", 5))),
    Go("package p\n\n", "", "func F<k>(\n\ta int,\n\tb string,\n) int {", "\n\ts := `\n}\n`\n\treturn len(s) + <v>\n",
       "}\n\nvar (\n\tV<k> = struct{ Name string }{\n\t\tName: \"x)\",\n\t}\n\tW<k>, X<k> = (1 +\n\t\t2), 3\n)\n",
       (3, 11), (("V<k>", 14), ("W<k>", 17), ("X<k>", 17))),
    Go("package p\n\n", "// F<k> } note\n", "func (r *T<k>) F<k>() interface{} {", "\n\tvar L<k> = <v>\n\treturn L<k> // }\n",
       "}\n\nvar V<k> = map[string]int{\n\t\"a\": 1,\n}\n", (4, 7), (("L<k>", 5), ("V<k>", 9))),
)


@dataclass(frozen=True)
class Hcl:
    pre: str
    head: str
    body: str
    rest: str
    #: type, joined labels, first line, last line, body lines
    blocks: tuple[tuple[str, str, int, int, str], ...]
    #: joined labels of the block, its line, name, value, line
    attributes: tuple[tuple[str, int, str, str, int], ...]
    #: the file with the attribute ``name`` of the resource set to "n<k>"
    named: str

    @property
    def text(self) -> str:
        return self.pre + self.head + self.body + self.rest


_OLD = '  name = "a}b"\n  nested {\n    nation = <v>\n  }'
_LISTED = '  name      = "s"\n  nation_id = <v>\n  text      = <<EOT\n}\n${x}\nEOT\n  list = [\n    "a", "b",\n  ]'
_INNER = '  name   = "${var.a["}"]}-x" // c\n  nation = { id = <v>, n = 2 }\n\n  nested "l" {\n    on = true\n  }'
HCL = (
    Hcl('# { note\n', 'resource "supplier" "s<k>" {', f"\n{_OLD}\n", '}\n\nvariable "v<k>" {\n  default = "x"\n}\n',
        (("resource", "supplier,s<k>", 2, 7, _OLD), ("nested", "", 4, 6, "    nation = <v>"), ("variable", "v<k>", 9, 11, '  default = "x"')),
        (("supplier,s<k>", 2, "name", '"a}b"', 3), ("", 4, "nation", "<v>", 5), ("v<k>", 9, "default", '"x"', 10)),
        '# { note\nresource "supplier" "s<k>" {\n  name = "n<k>"\n  nested {\n    nation = <v>\n  }\n}\n\nvariable "v<k>" {\n  default = "x"\n}\n'),
    Hcl('variable "v<k>" { default = 1 }\n\n', 'resource "supplier" "s<k>" {', f" # note {{\n{_LISTED}\n", "}\n",
        (("variable", "v<k>", 1, 1, "default = 1"), ("resource", "supplier,s<k>", 3, 13, _LISTED)),
        (("v<k>", 1, "default", "1", 1), ("supplier,s<k>", 3, "name", '"s"', 4), ("supplier,s<k>", 3, "nation_id", "<v>", 5),
         ("supplier,s<k>", 3, "text", "<<EOT\n}\n${x}\nEOT", 6), ("supplier,s<k>", 3, "list", '[\n"a","b",\n]', 10)),
        'variable "v<k>" { default = 1 }\n\nresource "supplier" "s<k>" { # note {\n  name      = "n<k>"\n  nation_id = <v>\n'
        '  text      = <<EOT\n}\n${x}\nEOT\n  list = [\n    "a", "b",\n  ]\n}\n'),
    Hcl("/* } */\n", 'resource "supplier" "s<k>" {', f"\n{_INNER}\n", "}\n",
        (("resource", "supplier,s<k>", 2, 9, _INNER), ("nested", "l", 6, 8, "    on = true")),
        (("supplier,s<k>", 2, "name", '"${var.a["}"]}-x"', 3), ("supplier,s<k>", 2, "nation", "{id=<v>,n=2}", 4), ("l", 6, "on", "true", 7)),
        '/* } */\nresource "supplier" "s<k>" {\n  name   = "n<k>" // c\n  nation = { id = <v>, n = 2 }\n\n  nested "l" {\n    on = true\n  }\n}\n'),
)


def column(template: str, **values: Column) -> Column:
    """The template with each ``<name>`` replaced by a column's value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def by_shape(key: Column, templates: list[str], **values: Column) -> Column:
    """The template of the row's shape (key modulo their number)."""
    out = F.when(F.lit(False), F.lit(""))
    for i, t in enumerate(templates):
        out = out.when(key % len(templates) == i, column(t, **values))
    return out


def sql(template: str, **values: str) -> str:
    """The same in SQL."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '<{name}>', ({value})::VARCHAR)"
    return out


def sql_by_shape(key: str, templates: list[str], **values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql(t, **values)}" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {whens} END"
