"""Parsing queries on sources with strings, templates, heredocs and comments that hold brackets, and heads and imports of several lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincode.functions.shared import spread
from graincode.operators import parsing

from . import projections as p
from .registry import query

#: A source of each language; %d is a number.
SOURCES = {
    'python': r'''import os
from a.b import (
    c,  # d
    e as f,
)
TEXT = """
def dead(): pass
class Dead:
"""
class K%d:
    """A class."""

    @staticmethod
    def run(
        x: int,
        s: str = "} def no():",
    ) -> int:
        return helper(f"{x} {s!r}")


def helper(v):
    # helper(dead)
    return c(v)
''',
    'go': r'''package a

import (
	"fmt" // "x"
	str "strings"
)
/* func Dead() { */
type K%d struct {
	a string
}

func (k *K%d) Run(
	x int,
	f func(int) (int, error),
) (int, error) {
	s := `} not the end {
"quoted"`
	c := '}'
	return helper("}", s, c)
}

func helper(v ...any) int {
	return 1
}
''',
    'java': r'''package a;

import java.util.List;
import static a.b.C.*;

public class K%d<T extends Comparable<T>>
    implements Runnable {
  static final String S = """
    } class Dead { void no() {} }
    """;
  // }
  @Override
  public Map<String, List<T>> run(
      int x,
      Function<Integer, T> f) throws IOException {
    char c = '}';
    return helper("}");
  }

  K%d(int a) {
    this.a = a;
  }

  abstract int size();
}
''',
    'javascript': r'''import {
  a,
  b as c,
} from './m%d';
import d from "./d";
// import dead from './dead';
const text = `
import no from './no'
function dead() { ${ a({ k: `}` }) } }
`;
export class K%d extends B {
  run(x = { y: "}" }) {
    const re = /[}]{2}\/"/g;
    return helper(`${x.map((q) => { return `}${q}`; })}`);
  }
}

export const arrow = async (
  x,
) => {
  return x; /* } */
};

export default function helper(v) {
  return arrow(v);
}
''',
    'typescript': r'''import type { A } from "./a";
export interface P<T> {
  run(x: T): { y: string };
}
export type Q<T> = {
  a: T;
};
export abstract class K%d<T> {
  private run<U>(cb: (x: T) => U, s = "}"): { y: U } {
    return helper(cb);
  }
}
const enum E {
  A = '{',
}
export function helper(v: any): string {
  return `}` + v;
}
''',
    'php': r'''<?php
namespace A;
use App\{M, N as O};
use App\P as Q;
interface I {
}
final class K%d implements I {
  use Log;
  // }
  public function run(
    int $x
  ): string {
    $s = <<<TXT
} function dead() {
TXT;
    return helper("}" . $s, '}');
  }
}
# function dead2() {}
function helper($v) {
  return trim($v);
}
''',
    'rust': r'''use std::{
    fmt,
    io,
};
/* outer /* fn dead() {} */ } */
pub struct K%d<'a> {
    s: &'a str,
}
impl<'a> fmt::Display for K%d<'a> {
    fn run<F: Fn(i32) -> i32>(
        &self,
        f: F,
    ) -> fmt::Result
    where
        F: Copy,
    {
        let c = '}';
        let r = r#"} " {"#;
        helper(f(1), "}")
    }
}
pub(crate) async fn helper(v: i32) -> i32 {
    v.abs()
}
''',
}


def _sources(spark, d):
    n = F.col("p_partkey").cast("string")
    rows = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("template")) for k, v in SOURCES.items()])
    t = spread(p.table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.inline(rows))
    return t.select(F.concat(F.lit("scan/"), "language", F.lit("/f"), n).alias("file"), "language", F.replace("template", F.lit("%d"), n).alias("content"))


@query(r"""WITH s(language, ord, name, kind, parent, signature, start_line, end_line) AS (VALUES
    ('python', 0, 'K%', 'class', NULL, 'class K%', 10, 18), ('python', 1, 'run', 'method', 'K%', 'method run((x: int, s: str=''} def no():'')) -> int', 13, 18),
    ('python', 2, 'helper', 'function', NULL, 'function helper((v))', 21, 23), ('go', 0, 'K%', 'struct', NULL, 'struct K%', 8, 10),
    ('go', 1, 'Run', 'method', 'K%', 'method Run((x int, f func(int) (int, error)))', 12, 20), ('go', 2, 'helper', 'function', NULL, 'function helper((v ...any))', 22, 24),
    ('java', 0, 'K%', 'class', NULL, 'class K%', 6, 25), ('java', 1, 'run', 'method', 'K%', 'method run((int x, Function<Integer, T> f))', 12, 18),
    ('java', 2, 'K%', 'method', 'K%', 'method K%((int a))', 20, 22), ('java', 3, 'size', 'method', 'K%', 'method size(())', 24, 24), ('javascript', 0, 'K%', 'class', NULL, 'class K%', 11, 16),
    ('javascript', 1, 'run', 'method', 'K%', 'method run((x = {y: "}"}))', 12, 15), ('javascript', 2, 'arrow', 'function', NULL, 'function arrow((x))', 18, 22),
    ('javascript', 3, 'helper', 'function', NULL, 'function helper((v))', 24, 26), ('typescript', 0, 'P', 'interface', NULL, 'interface P', 2, 4),
    ('typescript', 1, 'run', 'method', 'P', 'method run((x: T))', 3, 3), ('typescript', 2, 'Q', 'type_alias', NULL, 'type_alias Q', 5, 7),
    ('typescript', 3, 'K%', 'class', NULL, 'class K%', 8, 12), ('typescript', 4, 'run', 'method', 'K%', 'method run((cb: (x: T) => U, s = "}"))', 9, 11),
    ('typescript', 5, 'E', 'enum', NULL, 'enum E', 13, 15), ('typescript', 6, 'helper', 'function', NULL, 'function helper((v: any))', 16, 18),
    ('php', 0, 'I', 'interface', NULL, 'interface I', 5, 6), ('php', 1, 'K%', 'class', NULL, 'class K%', 7, 18), ('php', 2, 'run', 'method', 'K%', 'method run((int $x))', 10, 17),
    ('php', 3, 'helper', 'function', NULL, 'function helper(($v))', 20, 22), ('rust', 0, 'K%', 'struct', NULL, 'struct K%', 6, 8), ('rust', 1, 'K%', 'class', NULL, 'class K%', 9, 21),
    ('rust', 2, 'run', 'method', 'K%', 'method run((&self, f: F))', 10, 20), ('rust', 3, 'helper', 'function', NULL, 'function helper((v: i32))', 22, 24))
SELECT 'scan/' || language || '/f' || p_partkey AS file, ord::INT AS ord, replace(name, '%', p_partkey::VARCHAR) AS name, kind, replace(parent, '%', p_partkey::VARCHAR) AS parent, replace(signature, '%', p_partkey::VARCHAR) AS signature,
    start_line::INT AS start_line, end_line::INT AS end_line FROM part, s""")
def parse_scan_symbols(spark, d):
    return parsing.symbols_of(parsing.parse(_sources(spark, d), parts=("symbols",))).select("file", "ord", "name", "kind", "parent", "signature", "start_line", "end_line")


@query(r"""WITH i(language, module, alias, names, line) AS (VALUES
    ('python', 'os', NULL, '', 1), ('python', 'a.b', NULL, 'c,e', 2), ('go', 'fmt', NULL, '', 4), ('go', 'strings', 'str', '', 5), ('java', 'java.util.List', NULL, '', 3),
    ('java', 'a.b.C.*', NULL, '', 4), ('javascript', './m%', NULL, 'a,b as c', 1), ('javascript', './d', NULL, 'd', 5), ('typescript', './a', NULL, 'A', 1),
    ('php', 'App', NULL, 'M,N as O', 3), ('php', 'App\P', 'Q', '', 4), ('rust', 'std::{fmt, io}', NULL, '', 1))
SELECT 'scan/' || language || '/f' || p_partkey AS file, replace(module, '%', p_partkey::VARCHAR) AS module, alias, names, line::INT AS line FROM part, i""")
def parse_scan_imports(spark, d):
    return parsing.imports_of(parsing.parse(_sources(spark, d), parts=("imports",))).select("file", "module", "alias", F.array_join("names", ",").alias("names"), "line")


@query(r"""WITH c(language, caller, callee, line) AS (VALUES
    ('python', 'run', 'helper', 18), ('python', 'helper', 'c', 23), ('go', 'Run', 'helper', 19), ('java', 'run', 'helper', 17), ('javascript', '<module>', 'a', 9),
    ('javascript', 'run', 'helper', 14), ('javascript', 'run', 'map', 14), ('javascript', 'helper', 'arrow', 25), ('typescript', 'run', 'helper', 10), ('php', 'run', 'helper', 16),
    ('php', 'helper', 'trim', 21), ('rust', 'run', 'helper', 19), ('rust', 'run', 'f', 19), ('rust', 'helper', 'abs', 23))
SELECT 'scan/' || language || '/f' || p_partkey || '::' || caller AS source, callee AS target, 'scan/' || language || '/f' || p_partkey AS source_file, max(line)::INT AS line FROM part, c GROUP BY ALL""")
def parse_scan_calls(spark, d):
    return parsing.call_edges(parsing.parse(_sources(spark, d), parts=("calls",))).select("source", "target", "source_file", "line")
