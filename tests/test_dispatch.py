"""The syntax tier first, patterns where it finds nothing: rows derived by hand."""

import pytest

from ctxforge.operators import code, prompts, syntax

FILES = [
    (0, "src/a.ts", "import { x as y } from './b';\nexport async function load(\n  id: string,\n): Promise<void> {\n}\nexport class Part {\n  run(n: number) {\n  }\n}\n"),
    (1, "py/m.py", '"""Module doc for orders."""\nimport os\ndef go(a,\n       b):\n    pass\nclass K:\n    def m(self):\n        pass\n'),
    (2, "py/broken.py", "import sys\ndef broken(:\n    pass\n"),
    (3, "j/A.java", "package p;\nimport java.util.List;\npublic class A {\n  public int size() {\n    return 1;\n  }\n}\n"),
    (4, "notes.md", "# title\n"),
    (5, "src/empty.ts", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "ord long, path string, content string")


def test_rows(files):
    found = syntax.dispatch(files)
    assert {r["ord"]: r["parser"] for r in found.select("ord", "parser").collect()} == {0: "syntax", 1: "syntax", 2: "patterns", 3: "syntax", 4: "patterns", 5: "patterns"}
    assert found.drop("parser").schema["symbols"].dataType == code.parse(files).schema["symbols"].dataType
    symbols = {(r["ord"], r["name"], r["kind"], r["exported"], r["line"]) for r in code.symbol_rows(found).collect()}
    assert symbols >= {(0, "load", "function", True, 2), (0, "run", "method", False, 7), (0, "Part", "class", True, 6), (1, "go", "function", True, 3), (1, "K", "class", True, 6), (3, "A", "class", True, 3), (3, "size", "method", False, 4)}
    assert not any(o in (4, 5) for o, *_ in symbols)
    imports = {(r["ord"], r["source"]) for r in code.import_rows(found).collect()}
    assert imports == {(0, "./b"), (1, "os"), (2, "sys"), (3, "java.util.List")}


def test_compress_and_prompts_take_either(spark, files):
    by = {r["ord"]: r for r in code.compress(files, syntax.dispatch).collect()}
    assert "method:run" in by[0]["skeleton"] and "method:run" not in {r["ord"]: r for r in code.compress(files).collect()}[0]["skeleton"]
    assert by[1]["purpose"] == "Module doc for orders."
    body = "export class Part {\n" + "".join(f"  run{i}(n: number) {{\n    return {i};\n  }}\n" for i in range(40)) + "}\n"
    ask = spark.createDataFrame([(1, f"see\n```ts\n{body}```\nend")], "prompt_id long, prompt string")
    assert "method run7" in prompts.compress(ask, syntax.dispatch).first()["compressed"]


def test_largest_deltas(files):
    rows = [tuple(r)[2:] for r in syntax.largest_deltas(files, 3).collect()]
    first = syntax.largest_deltas(files, 3).collect()
    assert [abs(r["delta"]) for r in first] == sorted((abs(r["delta"]) for r in first), reverse=True) and len(rows) == 3
    by = {r["ord"]: (r["by_patterns"], r["by_syntax"]) for r in syntax.largest_deltas(files, 10).collect()}
    assert by[3] == (0, 2) and by[2][1] == 0 and by[4] == (0, 0) and by[0] == (1, 3)
