"""Source files in all languages of the syntax tier, and what they declare, written out by hand.

KEY stands for a file's number. A declaration is (name, kind, exported); an import is its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.functions.language import detect_language
from ctxforge.operators import code as K
from ctxforge.operators import syntax
from ctxforge.plans.inputs import parts

SAMPLES = {
    "ts": (
        """// Orders of part KEY
import { load as get, save } from './storeKEY';
import * as zod from "zod";
export async function fetchKEY<T>(
  id: string,
  n: number,
): Promise<void> {
  if (id) { return; }
}
export class PartKEY extends Base {
  private hidden() { }
  public run(x: number): void { for (;;) { } }
  static async make() { }
}
const sumKEY = async (a, b) => { };
export const LIMIT = 5;
let text = "function fake() {}";
interface Opts { a: string }
""",
        (("fetchKEY", "function", True), ("run", "method", False), ("make", "method", False), ("PartKEY", "class", True), ("sumKEY", "function", False), ("LIMIT", "constant", True), ("text", "variable", False), ("Opts", "interface", False)),
        ("./storeKEY", "zod"),
    ),
    "py": (
        """import os
from typing import (
    Any,
    List as L,
)
@wrap
@other(1)
async def fetchKEY(a,
                   b): pass
class ThingKEY(Base):
    def method(self): pass
def _hidden(): pass
""",
        (("fetchKEY", "function", True), ("ThingKEY", "class", True), ("_hidden", "function", False)),
        ("os", "typing"),
    ),
    "go": (
        """package m
import (
	_ "side/KEY"
	x "named"
	"fmt"
)
type ServerKEY struct {
}
type Doer interface {
}
func (s *ServerKEY) Run(a int) error {
}
func hiddenKEY() {}
""",
        (("ServerKEY", "struct", True), ("Doer", "interface", True), ("Run", "method", True), ("hiddenKEY", "function", False)),
        ("side/KEY", "named", "fmt"),
    ),
    "rs": (
        """use std::{io, fmt::{self, Debug as D}};
pub struct ShapeKEY { x: u8 }
pub trait Area { }
impl ShapeKEY {
    pub fn new() -> ShapeKEY { ShapeKEY {} }
    fn own(&self) {}
}
pub enum Kind { X }
async fn runKEY() {}
""",
        (("ShapeKEY", "struct", True), ("Area", "trait", True), ("new", "method", True), ("own", "method", False), ("Kind", "enum", True), ("runKEY", "function", False)),
        ("std", "std::fmt", "std::fmt"),
    ),
    "java": (
        """package a.b;
import static a.b.Helper;
import java.util.List;
public class StoreKEY {
  public int run(int a) { return 1; }
  private void hidden() { }
}
record PointKEY(int a) { }
""",
        (("StoreKEY", "class", True), ("run", "method", False), ("PointKEY", "class", False)),
        ("a.b.Helper", "java.util.List"),
    ),
    "kt": (
        """package a.b
import a.b.Other
private fun hiddenKEY() {}
suspend fun loadKEY(x: Int) {}
internal class Inner
data class DataKEY(val a: Int)
""",
        (("hiddenKEY", "function", False), ("loadKEY", "function", True), ("Inner", "class", False), ("DataKEY", "class", True)),
        ("a.b.Other",),
    ),
    "swift": (
        """import Foundation
public struct ShapeKEY { }
func plainKEY() { }
open class Base { }
protocol Drawn { }
""",
        (("ShapeKEY", "struct", True), ("plainKEY", "function", False), ("Base", "class", True), ("Drawn", "protocol", False)),
        ("Foundation",),
    ),
    "rb": (
        """require "json"
module ModKEY
  class OrderKEY
    def run
    end
    def self.make
    end
  end
end
""",
        (("ModKEY", "class", True), ("OrderKEY", "class", True), ("run", "function", True), ("make", "function", True)),
        ("json",),
    ),
    "php": (
        """<?php
use App;
function handleKEY($a) { }
final class PageKEY { }
interface Shown { }
trait Logged { }
""",
        (("handleKEY", "function", True), ("PageKEY", "class", True), ("Shown", "interface", True), ("Logged", "trait", True)),
        ("App",),
    ),
    "cpp": (
        """#include <vector>
#include "own.h"
static int hiddenKEY(int a) { return a; }
int runKEY(int a) {
  return 1;
}
struct PointKEY { int x; };
struct Later;
typedef int num;
namespace n {
void inner() { }
}
""",
        (("hiddenKEY", "function", False), ("runKEY", "function", True), ("PointKEY", "struct", True), ("num", "type", True), ("inner", "function", True)),
        ("vector", "own.h"),
    ),
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KEY = "CAST(p_partkey AS VARCHAR(9))"
_TEXT = " ".join(f"WHEN {i} THEN {_literal(text)}" for i, (text, _, _) in enumerate(SAMPLES.values()))
_NAME = " ".join(f"WHEN {i} THEN '.{ext}'" for i, ext in enumerate(SAMPLES))
SOURCES = f"SELECT p_partkey AS ord, concat('src/f', {_KEY}, CASE p_partkey % 10 {_NAME} END) AS path, replace(CASE p_partkey % 10 {_TEXT} END, 'KEY', {_KEY}) AS content FROM part"


def _files(s: SparkSession, d: str) -> DataFrame:
    parts(s, d).createOrReplaceTempView("ctxforge_part")
    return s.sql(SOURCES.replace("FROM part", "FROM ctxforge_part"))


def _in_sql(s, d):
    """The same symbols from a table function in SQL."""
    syntax.register(s)
    _files(s, d).withColumn("language", detect_language(F.col("path"))).createOrReplaceTempView("ctxforge_sources")
    return s.sql("SELECT f.ord, c.name, c.kind, c.exported FROM ctxforge_sources f, LATERAL code_symbols(f.content, f.language) c")


QUERIES = {
    "code_symbols_sql": _in_sql,
    "language_symbols": lambda s, d: K.symbol_rows(syntax.dispatch(_files(s, d))).select("ord", "path", "place", "name", "kind", "exported"),
    "language_imports": lambda s, d: K.import_rows(syntax.dispatch(_files(s, d))).select("ord", "place", "source"),
}


def _rows(column: int) -> str:
    rows = []
    for i, sample in enumerate(SAMPLES.values()):
        for place, found in enumerate(sample[column]):
            values = [_literal(found)] if isinstance(found, str) else [_literal(found[0]), _literal(found[1]), str(found[2])]
            rows.append(f"({i}, CAST({place} AS INT), {', '.join(values)})")
    return ", ".join(rows)


SQL = {
    "code_symbols_sql": f"SELECT p_partkey AS ord, replace(name, 'KEY', {_KEY}) AS name, kind, exported FROM part JOIN (VALUES {_rows(1)}) v(lang, place, name, kind, exported) ON p_partkey % 10 = lang",
    "language_symbols": f"SELECT p_partkey AS ord, concat('src/f', p_partkey, CASE p_partkey % 10 {_NAME} END) AS path, place, replace(name, 'KEY', {_KEY}) AS name, kind, exported FROM part JOIN (VALUES {_rows(1)}) v(lang, place, name, kind, exported) ON p_partkey % 10 = lang",
    "language_imports": f"SELECT p_partkey AS ord, place, replace(source, 'KEY', {_KEY}) AS source FROM part JOIN (VALUES {_rows(2)}) v(lang, place, source) ON p_partkey % 10 = lang",
}
