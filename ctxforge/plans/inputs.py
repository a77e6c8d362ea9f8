"""Inputs of the queries, derived from the fixture tables.

Each derivation is SQL that Spark and DuckDB both run, so a query and its SQL see the same rows: the tables
hold no code, logs or cue phrases of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxforge.sources.scratch import written

REQUESTS = """
SELECT event_id, user_id AS session_id, user_id % 7 AS project_id, event_type AS tool, ts, 100 + event_id % 900 AS original,
       CAST(floor((100 + event_id % 900) * (event_id % 10) / 10) AS BIGINT) AS saved
FROM events
"""

LOG_LINES = """
SELECT user_id AS log_id, event_id,
       concat('2024-01-0', CAST(1 + event_id % 9 AS VARCHAR(9)), 'T10:', CAST(10 + event_id % 50 AS VARCHAR(9)), ':00Z ',
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'debug' ELSE 'INFO' END, ' ',
         CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'option is deprecated' WHEN 1 THEN 'disk at :93 percent' ELSE 'slow query' END
              WHEN event_type <> 'error' THEN 'step finished'
              ELSE CASE event_id % 11 WHEN 0 THEN 'Cannot find module x' WHEN 1 THEN 'EACCES permission denied' WHEN 2 THEN 'connect ECONNREFUSED 0xdeadbeef:80'
                   WHEN 3 THEN 'JavaScript heap out of memory' WHEN 4 THEN 'TypeError: x is not a function' WHEN 5 THEN 'Syntax error near line:12'
                   WHEN 6 THEN 'request timed out' WHEN 7 THEN 'value is undefined' WHEN 8 THEN 'disk failure' WHEN 9 THEN 'Module not found' ELSE 'fatal flaw' END END,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat(chr(10), '    at run (a.js:', CAST(event_id % 7 AS VARCHAR(9)), ':1)', chr(10), '    at error (b.js:2:1)') ELSE '' END,
         CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN concat(chr(10), '  File "m.py", line 3', chr(10), ' at c', chr(10), ' at d', chr(10), ' at e') ELSE '' END,
         CASE WHEN event_id % 13 = 0 THEN concat(chr(10), '   ', chr(10), ' at lone') ELSE '' END) AS line
FROM events
"""

MESSAGES = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE role END AS role,
       concat(CASE (conv_id + turn) % 10 WHEN 0 THEN 'goal: ' WHEN 1 THEN 'I need to ' WHEN 2 THEN 'todo: ' WHEN 3 THEN '- [ ] ' WHEN 4 THEN 'Using ' WHEN 5 THEN 'error: '
                WHEN 6 THEN 'done: ' WHEN 7 THEN concat('I''ve fixed ', '') WHEN 8 THEN 'we''ll ' ELSE '' END,
              text, chr(10), CASE turn % 4 WHEN 0 THEN concat('please ', substr(text, 3), chr(10), 'cannot: ', substr(text, 5), chr(10), 'failed: ', substr(text, 9))
                WHEN 1 THEN concat('Done: ', substr(text, 2)) WHEN 2 THEN concat('see src/a', CAST(conv_id AS VARCHAR(20)), '/b.ts and ./c.py', chr(10), '```ts', chr(10), 'x', chr(10), '```')
                ELSE concat('decided: ', substr(text, 4), chr(10), 'next step: ', substr(text, 8)) END) AS text
FROM conversations
"""

ITEMS = """
SELECT doc_id AS item_id, doc_id AS ord,
       concat(CASE doc_id % 9 WHEN 0 THEN 'ERROR at 2024-01-05 10:11:12.5Z ' WHEN 1 THEN 'user: ' WHEN 2 THEN 'PASS ' WHEN 3 THEN 'x Error: bad 0xDEADBEEF id 12345 ' ELSE '' END,
              text) AS text
FROM documents
"""

BUDGET_ITEMS = """
SELECT doc_id % 20 AS budget_id, doc_id AS ord, concat('doc', CAST(doc_id AS VARCHAR(20))) AS name, text AS content,
       CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority
FROM documents
"""

#: Templated source files: TypeScript, JavaScript, Python, Go, Rust and text by key.
FILES = """
SELECT p_partkey AS ord,
  CASE p_partkey % 6
    WHEN 0 THEN CASE p_partkey % 72 WHEN 0 THEN concat('src/m', CAST(p_partkey % 50 AS VARCHAR(9)), '/server/index.ts') ELSE concat('src/m', CAST(p_partkey % 50 AS VARCHAR(9)), '/f', CAST(p_partkey AS VARCHAR(9)), '.ts') END
    WHEN 1 THEN CASE p_partkey % 30 WHEN 1 THEN concat('lib/config', CAST(p_partkey AS VARCHAR(9)), '.config.js') ELSE concat('lib/Xq', CAST(p_partkey AS VARCHAR(9)), '.js') END
    WHEN 2 THEN concat('py/zz', CAST(p_partkey AS VARCHAR(9)), '.py')
    WHEN 3 THEN concat('go/service_', CAST(p_partkey AS VARCHAR(9)), '.go')
    WHEN 4 THEN concat('rs/k', CAST(p_partkey AS VARCHAR(9)), '.rs')
    ELSE CASE p_partkey % 12 WHEN 5 THEN concat('doc/readme', CAST(p_partkey AS VARCHAR(9)), '.md') ELSE 'src/index.ts' END END AS path,
  CASE p_partkey % 6
    WHEN 0 THEN concat(CASE WHEN p_partkey % 4 = 0 THEN concat('/**', chr(10), ' * Handles orders of part ', CAST(p_partkey AS VARCHAR(9)), '.', chr(10), ' */', chr(10)) ELSE '' END,
      'import { load, save as keep } from ''./f', CAST(p_partkey + 150 AS VARCHAR(9)), ''';', chr(10),
      'import React, { useState } from ''react'';', chr(10), 'import * as zod from "zod";', chr(10), 'import type { Opts } from ''../types'';', chr(10),
      'import ''./style', CAST(p_partkey AS VARCHAR(9)), '.css'';', chr(10),
      'const { a, b } = require(''express'');', chr(10),
      'export async function load', CAST(p_partkey AS VARCHAR(9)), '<T>(id: string, n: number): Promise<void> {', chr(10), '  return;', chr(10), '}', chr(10),
      CASE WHEN p_partkey % 3 = 0 THEN concat('export class Part', CAST(p_partkey AS VARCHAR(9)), ' extends Base {', chr(10), '}', chr(10), 'abstract class Inner {}', chr(10)) ELSE '' END,
      'interface Opts', CAST(p_partkey AS VARCHAR(9)), ' { a: string }', chr(10), 'export type Id = string;', chr(10),
      'const run = async (x) => x;', chr(10), '  export const size = (y) => y;', chr(10), 'export enum Kind { A, B }', chr(10), 'const enum Flag { C }', chr(10),
      'export { x, y as z };', chr(10), 'export default run;', chr(10), '// ', p_name)
    WHEN 1 THEN concat('import next from ''next/app'';', chr(10), 'var q = require("jest");', chr(10), 'export default function main(a, b) {', chr(10), '}', chr(10), 'function helper', CAST(p_partkey AS VARCHAR(9)), '() { return 1; }', chr(10), p_type)
    WHEN 2 THEN concat(CASE WHEN p_partkey % 4 = 2 THEN concat(repeat('"', 3), 'Module about ', p_brand, ' goods.', chr(10), 'More.', repeat('"', 3), chr(10)) ELSE '' END,
      'from os.path import (join, split as cut)', chr(10), 'from typing import *', chr(10), 'import sys, json as js', chr(10),
      'async def fetch', CAST(p_partkey AS VARCHAR(9)), '(url, *args):', chr(10), '    pass', chr(10), 'def _hidden():', chr(10), '    pass', chr(10), 'class Thing', CAST(p_partkey AS VARCHAR(9)), '(Base):', chr(10), '    def method(self):', chr(10), '        pass')
    WHEN 3 THEN concat('package m', chr(10), 'import "fmt"', chr(10), 'func Run', CAST(p_partkey AS VARCHAR(9)), '(a int) int {', chr(10), '}', chr(10), 'func hidden() {}', chr(10), 'func (r *R) Method() {}')
    WHEN 4 THEN concat('use std::io;', chr(10), 'pub fn open', CAST(p_partkey AS VARCHAR(9)), '() {}', chr(10), 'pub async fn twice() {}', chr(10), 'fn close() {}', chr(10), 'pub fn twice() {}')
    ELSE concat('# ', p_name, chr(10), CASE WHEN p_partkey % 12 = 5 THEN p_type ELSE 'export const one = (a) => a;' END) END AS content
FROM part
"""

TABLES = {"requests": (REQUESTS, "events"), "log_lines": (LOG_LINES, "events"), "messages": (MESSAGES, "conversations"), "items": (ITEMS, "documents"), "budget_items": (BUDGET_ITEMS, "documents"), "files": (FILES, "part")}


#: Rows of the part table that a task makes files of.
PARTS = 5_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table, dealt out by key: a million rows are a few megabytes, so a task or two read them all, and each row becomes a file
    that is parsed where it is made. They are written so that no filter over what is parsed moves ahead of the dealing."""
    table = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = -(-table.count() // PARTS)
    return written(table.repartition(tasks, "p_partkey"), "parts") if tasks > 1 else table


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, table = TABLES[name]
    rows = parts(spark, sf_dir) if table == "part" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows.createOrReplaceTempView(f"ctxforge_{table}")
    return spark.sql(sql.replace(f"FROM {table}", f"FROM ctxforge_{table}"))


def cte(*names: str) -> str:
    return ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, content): a log's lines in order of their events."""
    from pyspark.sql import functions as F

    lines = derived(spark, sf_dir, "log_lines").groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("ls"))
    return lines.select("log_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


LOGS_CTE = "logs AS (SELECT log_id, string_agg(line, chr(10) ORDER BY event_id) AS content FROM log_lines GROUP BY log_id)"
