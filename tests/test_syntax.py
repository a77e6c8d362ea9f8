from ctxforge.operators import syntax


def names(text, language, kind=None):
    found = syntax.extract(text, language)
    return [(s["name"], s["kind"], s["exported"]) for s in found["symbols"] if kind in (None, s["kind"])]


def test_typescript():
    text = """// Auth helpers for the API
import a, { b as c } from 'x';
import * as ns from "y";
export async function load<T>(
  id: string,
  n: number,
): Promise<void> {
  if (id) { return; }
}
export class Part extends Base {
  private hidden() { }
  public run(x: number): void { for (;;) { } }
  static async make() { }
}
const fn = async (a, b) => { };
export const LIMIT = 5;
let s = "function fake() {}";
interface Opts { a: string }
export { fn as go };
"""
    found = syntax.extract(text, "typescript")
    assert [(s["name"], s["kind"]) for s in found["symbols"]] == [("load", "function"), ("run", "method"), ("make", "method"), ("Part", "class"), ("fn", "function"), ("LIMIT", "constant"), ("s", "variable"), ("Opts", "interface")]
    load = found["symbols"][0]
    assert (load["line"], load["line_end"], load["is_async"], load["exported"]) == (4, 9, True, True) and "id: string, n: number" in load["signature"]
    assert found["exports"] == ["load", "Part", "LIMIT", "go"] and found["comments"] == ["Auth helpers for the API"]
    assert [(i["source"], i["specifiers"]) for i in found["imports"]] == [("x", ["b", "a"]), ("y", ["* as ns"])]


def test_python():
    found = syntax.extract('"""Doc line.\nmore"""\nimport os\n__all__ = ["f"]\n@wrap\n@other(1)\nasync def f(a,\n b): pass\nclass K:\n    def m(self): pass\ndef _g(): pass\n', "python")
    assert [(s["name"], s["line"]) for s in found["symbols"]] == [("f", 5), ("K", 9), ("_g", 11)] and found["exports"] == ["f"] and found["comments"] == ["Doc line."]
    assert syntax.extract("def (", "python") is None


def test_other_languages():
    go = 'package m\nimport (\n\t_ "a/b"\n\tx "c"\n\t"d"\n)\ntype Server struct {\n}\ntype Doer interface {\n}\nfunc (s *Server) Run(a int) error {\n}\nfunc hidden() {}\n'
    assert names(go, "go") == [("Server", "struct", True), ("Doer", "interface", True), ("Run", "method", True), ("hidden", "function", False)]
    assert [(i["source"], i["is_side_effect"]) for i in syntax.extract(go, "go")["imports"]] == [("a/b", True), ("c", None), ("d", None)]
    rust = "use std::{io, fmt::{self, Debug as D}};\npub struct A { x: u8 }\npub trait T { }\nimpl A {\n    pub fn new() -> A { A {} }\n    fn own(&self) {}\n}\npub enum E { X }\nasync fn f() {}\n"
    assert names(rust, "rust") == [("A", "struct", True), ("T", "trait", True), ("new", "method", True), ("own", "method", False), ("E", "enum", True), ("f", "function", False)]
    assert [(i["source"], i["specifiers"]) for i in syntax.extract(rust, "rust")["imports"]] == [("std", ["io"]), ("std::fmt", ["self"]), ("std::fmt", ["D"])]
    java = "import static a.b.C;\npublic class K {\n  public int run(int a) { return 1; }\n  private void no() { }\n}\nrecord R(int a) { }\n"
    assert names(java, "java") == [("K", "class", True), ("run", "method", False), ("R", "class", False)]
    assert names("private fun a() {}\nsuspend fun b(x: Int) {}\ninternal class C\ndata class D(val a: Int)\n", "kotlin") == [("a", "function", False), ("b", "function", True), ("C", "class", False), ("D", "class", True)]
    assert names("public struct S { }\nfunc f() { }\nopen class C { }\nprotocol P { }\n", "swift") == [("S", "struct", True), ("f", "function", False), ("C", "class", True), ("P", "protocol", False)]
    assert names("module M\n  class A\n    def run\n    end\n    def self.make\n    end\n  end\nend\n", "ruby") == [("M", "class", True), ("A", "class", True), ("run", "function", True), ("make", "function", True)]
    assert names("<?php\nuse A\\B as C;\nfunction f($a) { }\nfinal class K { }\ninterface I { }\ntrait T { }\n", "php") == [("f", "function", True), ("K", "class", True), ("I", "interface", True), ("T", "trait", True)]
    cpp = '#include <vector>\nstatic int hidden(int a) { return a; }\nint run(int a) {\n  return 1;\n}\nstruct P { int x; };\nstruct Q;\ntypedef int num;\nnamespace n {\nvoid inner() { }\n}\n'
    assert names(cpp, "cpp") == [("hidden", "function", False), ("run", "function", True), ("P", "struct", True), ("num", "type", True), ("inner", "function", True)]


def test_udf_and_table_function(spark):
    files = spark.createDataFrame([("a.go", "go", "func Run() {}"), ("b.py", "python", "def ("), ("c.x", "unknown", "x"), ("d.go", "go", None)], "path string, language string, content string")
    got = {r["path"]: r["symbols"] for r in syntax.parse(files).collect()}
    assert got["a.go"][0]["name"] == "Run" and got["b.py"] is None and got["c.x"] is None and got["d.go"] is None
    syntax.register(spark)
    assert spark.sql("SELECT name, kind FROM code_symbols('func Run() {}', 'go')").first() == ("Run", "function")
