import pytest
from pyspark.sql.functions import udtf

from tesselog.functions import syntax
from tesselog.operators import code_chunks as C


def named(text, language):
    return [(a, b, node, name) for a, b, kind, node, name in C.chunks_of(text, language) if kind == "tree-sitter"]


TS = '''import { a } from "./a";

// adds
// two numbers
export function add(x: number, y: number): { sum: number } {
  const inner = () => x + y;
  return { sum: inner() };
}

/** a shape */
export interface Shape {
  area(): number;
}

export class Box<T> extends Base implements Shape {
  private size = 3;

  // how large
  constructor(private readonly w: number) {
    super();
  }

  get area(): number { return this.w; }

  static async make<T>(w: number): Promise<Box<T>> {
    if (w > 0) {
      return new Box(w);
    }
    return null;
  }
}

class Empty {
  x = 1;
}

export const double = (n: number): number => n * 2;
const plain = 5;
export const load = async function (p: string) {
  return `${p} } ${`{`} function no() {`;
};
let pick = x =>
  x.a
    .b;
declare function outside(a: string): void;
const o = { run(a) { return a; }, stop: 1 };
foo(function named() { return 1; });
'''


def test_typescript():
    assert named(TS, "typescript") == [
        (3, 8, "function_declaration", "add"),
        (10, 13, "interface_declaration", "Shape"),
        (18, 21, "method_definition", "constructor"),
        (23, 23, "method_definition", "area"),
        (25, 30, "method_definition", "make"),
        (33, 35, "class_declaration", "Empty"),
        (37, 37, "lexical_declaration", "double"),
        (39, 41, "lexical_declaration", "load"),
        (42, 44, "lexical_declaration", "pick"),
        (46, 46, "method_definition", "run"),
    ]


def test_javascript_has_no_interfaces_and_markup_is_text():
    text = "interface Foo { }\nexport default function App() {\n  return <p>Don't {x ? <b>{y}</b> : null}</p>;\n}\nconst View = ({ a }) => (\n  <div>{a}</div>\n);\nvar old = function () { return 1; };\n"
    assert named(text, "jsx") == [(2, 4, "function_declaration", "App"), (5, 7, "lexical_declaration", "View")]


def test_strings_comments_and_patterns_hold_no_braces():
    text = "function a() {\n  const s = '}'; // }\n  /* } */ const r = /[}/]\"/g; return \"\\\"}\" + `}${ {a: 1}.a }}`;\n}\nfunction b() {}\n"
    assert named(text, "javascript") == [(1, 4, "function_declaration", "a"), (5, 5, "function_declaration", "b")]


GO = '''package x

// Point is one.
type Point struct {
	X, Y int
}

type (
	A int
	B string
)

type ID = string

func New(m map[string]interface{}) (interface{}, error) {
	if m == nil { return nil, nil }
	type local struct{}
	return `}`, nil
}

/* moves
   it */
func (p *Point) Move(dx int) {
	p.X += dx
}

func Map[T any](xs []T) []T { return xs }
'''


def test_go():
    assert named(GO, "go") == [
        (3, 6, "type_declaration", "Point"),
        (8, 11, "type_declaration", "A"),
        (13, 13, "type_declaration", "ID"),
        (15, 19, "function_declaration", "New"),
        (21, 25, "method_declaration", "Move"),
        (27, 27, "function_declaration", "Map"),
    ]


JAVA = '''package x;

/** Doc. */
@Entity(name = "a")
public final class Box<T extends Comparable<T>> {
    private int n = count(3);
    private final Runnable r = () -> { run(); };

    // builds
    public Box(int n) { this.n = n; }

    @Override
    @SuppressWarnings({"a", "b"})
    public <R> List<R> map(Function<T, R> f) throws IOException {
        for (int i = 0; i < n; i++) { f.apply(null); }
        return new ArrayList<>() { public int size() { return 0; } };
    }

    abstract int size();

    enum Kind { A, B; int f() { return 1; } }
}

interface Shape {
    int area();
}

class Empty { int a; }

@interface Mark { String value() default ""; }
'''


def test_java():
    assert named(JAVA, "java") == [
        (9, 10, "constructor_declaration", "Box"),
        (12, 17, "method_declaration", "map"),
        (19, 19, "method_declaration", "size"),
        (21, 21, "enum_declaration", "Kind"),
        (24, 26, "interface_declaration", "Shape"),
        (28, 28, "class_declaration", "Empty"),
    ]


@pytest.mark.parametrize("text,language", [(TS, "typescript"), (GO, "go"), (JAVA, "java"), (TS, "python"), (TS[:400], "tsx"), ("{[(" * 500, "java"), ("`${" * 300, "javascript"), ("}" * 300 + "function a() {", "javascript"), ("class A {\r\n  b() {\r\n  }\r\n}\r\n", "javascript"), ("é" * 50 + "\n" + "x = '", "go")])
def test_every_line_is_covered_once_by_definitions_and_windows(text, language):
    lines = text.split("\n")
    chunks = C.chunks_of(text, language)
    covered = {i for a, b, *_ in chunks for i in range(a, b + 1)}
    assert {i for i, x in enumerate(lines, 1) if x.strip()} <= covered
    nodes = [i for a, b, kind, *_ in chunks if kind == "tree-sitter" and b - a < C.WINDOW for i in range(a, b + 1)]
    assert len(nodes) == len(set(nodes)) and all(1 <= a <= b <= len(lines) for a, b, *_ in chunks)


def test_long_definitions_are_windowed_and_keep_their_name():
    text = "function big() {\n" + "  x();\n" * 318 + "}\n"
    got = named(text, "typescript")
    assert len(got) == 7 and {g[2:] for g in got} == {("function_declaration", "big")} and got[0][:2] == (1, 50) and got[-1][1] == 320


def test_blank_keeps_places():
    for text, family in ((TS, "script"), (GO, "go"), (JAVA, "java")):
        bare, _ = syntax.blank(text, family)
        assert len(bare) == len(text) and [i for i, c in enumerate(bare) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_table_function_and_given_chunker(spark):
    spark.udtf.register("chunk_file", udtf(C.ChunkFile, returnType=C.ChunkFile.SCHEMA))
    spark.createDataFrame([(TS, "typescript"), (None, "go")], "content string, language string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT symbol_name FROM sources, LATERAL chunk_file(content, language) WHERE kind = 'tree-sitter'").collect()
    assert {"add", "make", "Empty"} <= {r.symbol_name for r in rows} and len(rows) == 10
    whole = C.chunk_files(spark.createDataFrame([("a.ts", "x\ny")], "path string, content string"), lambda content, language: [(1, 2, "whole", None, language)])
    assert [(r.kind, r.symbol_name, r.content) for r in whole.collect()] == [("whole", "typescript", "x\ny")]


@pytest.mark.parametrize("language,unit", [("java", "  int m%d(int a) { if (a > 0) { return g(a); } return 0; }\n"), ("typescript", "  m%d(a: number): { x: number } { return { x: g(a) }; }\n"), ("javascript", "const f%d = (a) =>\n  g(a)\n    .then(b);\n"), ("go", "func f%d(a int) error { return g(a) }\n")])
def test_large_files_in_linear_time(language, unit):
    import time

    def run(n):
        body = "".join(unit % i for i in range(n))
        text = f"class A {{\n{body}}}\n" if language in ("java", "typescript") else body
        began = time.perf_counter()
        got = named(text, language)
        return len(got), time.perf_counter() - began

    assert run(500)[0] == 500
    n, seconds = run(8000)
    assert n == 8000 and seconds < 10
