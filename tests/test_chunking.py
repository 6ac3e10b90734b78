from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenseek.operators import arrays, cutting as cut, syntax
from lumenseek.operators.syntax import scan_syntax, top_level_kinds
from lumenseek.plans.chunking import chunk_errors, chunk_files, fallback_chunks

# Fixed sample inputs: their expected lines are given.
VALIDATORS = """export function validateEmail(email: string): boolean {
    const regex = /^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$/;
    return regex.test(email);
}

export function validatePassword(password: string): boolean {
    return password.length >= 8;
}

export class UserValidator {
    validate(user: any): boolean {
        return this.validateEmail(user.email) &&
               this.validatePassword(user.password);
    }

    private validateEmail(email: string): boolean {
        return validateEmail(email);
    }

    private validatePassword(password: string): boolean {
        return validatePassword(password);
    }
}"""

API = """async function fetchUserData(userId) {
    const response = await fetch(`/api/users/${userId}`);
    return response.json();
}

async function updateUserProfile(userId, data) {
    const response = await fetch(`/api/users/${userId}`, {
        method: 'PUT',
        headers: { 'Content-Type': 'application/json' },
        body: JSON.stringify(data)
    });
    return response.json();
}

function debounce(fn, delay) {
    let timeoutId;
    return (...args) => {
        clearTimeout(timeoutId);
        timeoutId = setTimeout(() => fn(...args), delay);
    };
}"""

COMPONENT = """<template>
  <!-- note -->
  <p>{{ n }}</p>
</template>

<script lang="ts">
import x from 'y';

export default {
  props: { n: Number },
  emits: ['go'],
  data() {
    return { k: 1 };
  },
  computed: {
    twice() {
      return this.k * 2;
    },
  },
  methods: {
    run() {
      go();
    },
    walk: () => {
      go();
    },
  },
  watch: {
    n(v) {
      go(v);
    },
  },
  mounted() {
    go();
  },
  render() {
    return 1;
  },
};
</script>

<style scoped>
p { margin: 0 }
</style>
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, language string, text string")


@pytest.fixture
def points(spark):
    def run(text, language="ts", **options):
        row = scan_syntax(files(spark, ("f", language, text)), **options).first()
        return [(p.line, p.label) for p in row.points], row.comments
    return run


@pytest.fixture
def chunks(spark):
    def run(text, language="ts", **options):
        rows = chunk_files(files(spark, (f"f.{language}", language, text)), timestamp=0, **options)
        return [(r.start_line, r.end_line, r.type) for r in rows.orderBy("chunk_index_in_file").collect()]
    return run


def test_typescript_golden(chunks):
    assert chunks(VALIDATORS) == [(1, 5, "export"), (6, 9, "export"), (10, 10, "export"), (11, 15, "function"),
                                  (16, 19, "function"), (20, 23, "function")]


def test_javascript_golden(chunks):
    assert chunks(API, "js") == [(1, 5, "function"), (6, 14, "function"), (15, 16, "function"), (17, 21, "function")]


def test_other_languages_are_errors(spark):
    df = files(spark, ("a.py", "py", "def f(): pass"), ("b.ts", "ts", "  \n \n"))
    assert chunk_files(df).count() == 0
    assert [tuple(r) for r in chunk_errors(df).collect()] == [("a.py", "Unsupported file extension: py")]


def test_component(points, chunks):
    found, comments = points(COMPONENT, "vue")
    assert comments == [1]
    assert sorted(found) == sorted([
        (0, "Template"), (5, "Script"), (6, "Import"), (8, "Export"), (9, "Props Definition"), (10, "Emits Definition"),
        (11, "Data Function"), (11, "Function"), (15, "Vue Computed Method"), (20, "Vue Methods Method"),
        (23, "Vue Methods Method"), (28, "Vue Watch Method"), (32, "Lifecycle Hook"), (32, "Function"),
        (35, "Function"), (41, "Style")])
    kinds = [k for _, _, k in chunks(COMPONENT, "vue")]
    assert kinds == ["template", "script", "import", "const", "const", "data", "computed", "method", "method", "watch",
                     "lifecycle", "function", "css"]


def test_component_compat_is_one_line_early_and_shadows_hooks(points):
    found, _ = points(COMPONENT, "vue", compat=True)
    assert (7, "Export") in found and (10, "Data Function") in found
    assert found.index((10, "Function")) < found.index((10, "Data Function"))


def test_css(points):
    found, comments = points("/* c */\n.a,\n.b {\n x: y;\n}\n@media print {\n .c { d: e }\n}\n@import 'x';\n"
                             "@-webkit-keyframes k {\n from {}\n}\n.d { }\n.e { }", "css")
    assert found == [(1, "Rule"), (5, "Media Query"), (9, "Keyframes"), (12, "Rule"), (13, "Rule")]
    assert comments == [0]


def test_depth_rules(points):
    found, _ = points("""function outer() {
  function inner() {}
  const arrow = (a: number) => a;
  const many = (
    a,
    b
  ) => {
    return a;
  };
  const plain = 1;
  if (x) {
    function tooDeep() {}
  }
}
class A {
  static async run<T>(a: T): Promise<void> {
    function no() {}
  }
  field = () => 1;
  value = 2;
  declared(a: number): void;
  get it() { return 1; }
}
const o = {
  method() {
    return 1;
  },
  pair: () => 1,
};
export const p = {
  method() {},
};
module.exports = {
  go() {},
};
""")
    assert found == [
        (0, "Function"), (1, "Function"), (2, "Function"), (3, "Function"), (14, "Class"), (15, "Function"),
        (18, "Function"), (21, "Function"), (23, "Variable"), (24, "Function"), (29, "Export"), (33, "Function")]


def test_top_level_labels(points):
    text = """import a from 'a';
import('b');
export * from 'c';
abstract class B {}
interface I { a: string }
type T = { a: 1 };
enum E { A }
const enum F { A }
declare function d(): void;
declare const e: string;
function overloaded(a: string): void;
let v = 1;
var f = async function () {};
const g = x => x;
describe('it', () => {
  test();
});
exports.h = function () {};
export default async (x) => {
};
// end
"""
    found, comments = points(text)
    assert found == [
        (0, "Import"), (2, "Export"), (3, "Abstract Class"), (4, "Interface"), (5, "Type Alias"), (6, "Enum"),
        (7, "Enum"), (8, "Ambient"), (8, "Function"), (9, "Ambient"), (10, "Function Signature"), (10, "Function"),
        (11, "Variable"), (12, "Function"), (13, "Function"), (14, "Function"), (17, "Function"), (18, "Export"),
        (18, "Function")]
    assert comments == [20]
    plain, _ = points("interface I {}\ntype T = 1;\nclass C {}\n", "js")
    assert plain == [(2, "Class")]


def test_literals_and_comments_do_not_fool_the_scan(points):
    found, comments = points("""const s = "function x() {";
const t = `
function y() {
${a}
`;
/* function z() {
   } */
const r = /[{(]/g; // { open
const q = a / b / c;
function real() {}
""")
    assert found == [(0, "Variable"), (1, "Variable"), (7, "Variable"), (8, "Variable"), (9, "Function")]
    assert comments == [5, 7]


def test_markup_returns(points):
    text = """function App() {
  const x = 1;
  return (
    <div>
      {x}
    </div>
  );
}
export function Small() {
  return <b>hi</b>;
}
"""
    found, _ = points(text, "tsx")
    assert found == [(0, "Function"), (2, "JSX"), (8, "Export"), (8, "Function")]


def test_comments_and_decorators_lift_breakpoints(chunks):
    text = "const a = 1;\n\n// one\n// two\nfunction f() {}\n\n@Injectable()\nclass C {}\n"
    assert chunks(text) == [(1, 2, "variable"), (3, 6, "function"), (7, 9, "class")]


def test_import_and_export_runs_collapse(chunks):
    text = "import a from 'a';\nimport b from 'b';\nexport * from 'c';\nconst x = 1;\nimport d from 'd';\n"
    assert chunks(text) == [(1, 3, "import"), (4, 4, "variable"), (5, 6, "import")]


def test_variables_merge_and_keep_gap_lines(spark):
    text = "const a = 1;\nconst b = 2;\n\nlet c = 3;\nfunction f() {}\nvar d = 4;"
    rows = chunk_files(files(spark, ("f.ts", "ts", text)), timestamp=0).orderBy("chunk_index_in_file").collect()
    assert [(r.id, r.type, r.text) for r in rows] == [
        ("f.ts:1-4", "variable", "const a = 1;\nconst b = 2;\n\nlet c = 3;"),
        ("f.ts:5-5", "function", "function f() {}"), ("f.ts:6-6", "variable", "var d = 4;")]


def test_compat_recounts_start_lines(chunks):
    text = "\n\n\nfunction f() {}\nfunction g() {}"
    assert chunks(text) == [(4, 4, "function"), (5, 5, "function")]
    assert chunks(text, compat=True) == [(1, 1, "function"), (2, 2, "function")]


def brute_split(lines, cap, floor, back):
    out, start = [], 0
    while start < len(lines):
        end = min(start + cap, len(lines))
        if end < len(lines):
            for i in range(end - 1, max(start + floor, end - back) - 1, -1):
                t = lines[i].strip()
                if t in ("", "}", "};") or (t.endswith(";") and "for" not in t and "if" not in t):
                    end = i + 1
                    break
        if "\n".join(lines[start:end]).strip():
            out.append((start, end - start))
        start = end
    return out


@pytest.mark.parametrize("cap,floor,back", [(300, 15, 50), (20, 15, 50), (7, 2, 3), (5, 9, 4)])
def test_large_pieces_split_like_brute_force(spark, cap, floor, back):
    import random
    rng = random.Random(cap)
    kinds = ["a", "x();", "}", "", "for (;;);", "if (a) b();", "};", "word word"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(n)) for n in (1, 5, 19, 20, 21, 64, 300, 301, 1000)]
    df = files(spark, *[(str(i), "ts", t) for i, t in enumerate(texts)]).withColumn("lines", cut.split_lines(F.col("text")))
    none = F.array().cast("array<struct<line:int,label:string>>")
    df = df.withColumn("pieces", cut.cut(F.col("lines"), none)).withColumn(
        "parts", cut.split_large(F.col("pieces"), cap, floor, back))
    for r in df.collect():
        want = brute_split(r.text.split("\n"), cap, floor, back) if r.text.strip() else []
        assert [(p.start, len(p.lines)) for p in r.parts] == want, r.file_path


def test_small_pieces_and_overlap(spark):
    sizes = [2, 1, 5, 1, 1, 1]
    pieces = [(sum(sizes[:i]), None, [f"{i}.{k}" for k in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(pieces,)], "p array<struct<start:int,label:string,lines:array<string>>>")
    merged, wide = df.select(cut.merge_small(F.col("p"), 3), cut.add_overlap(F.col("p"), 2)).first()
    assert [(m.start, len(m.lines)) for m in merged] == [(0, 3), (3, 5), (8, 3)]
    assert [w.lines[0] for w in wide] == ["0.0", "0.0", "1.0", "2.3", "3.0", "4.0"]


def test_fallback_and_running_sum(spark):
    text = "\n".join(str(i) for i in range(650))
    rows = fallback_chunks(files(spark, ("f.ts", "ts", text))).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.type) for r in rows] == [(1, 300, "block"), (301, 600, "block"), (601, 650, "block")]
    values = list(range(1, 200))
    df = spark.createDataFrame([(values,), ([5],)], "v array<int>")
    got = [r[0] for r in df.select(arrays.running_sum(F.col("v"))).collect()]
    assert got == [[sum(values[:i + 1]) for i in range(len(values))], [5]]


@pytest.mark.parametrize("language,text,kind", [
    ("tsx", "const App = 1", "component"), ("tsx", "x\n  return <div>", "jsx"), ("ts", "const f = (a)", "function"),
    ("ts", "  abstract class X", "class"), ("ts", "export interface Y", "interface"), ("js", "enum Z", "type"),
    ("ts", "export { a }", "export"), ("ts", "import 'x'", "import"), ("ts", "export\nlet q", "variable"), ("ts", "go()", "block"),
    ("css", ".a {}", "block"), ("vue", "<style>\n<script>", "script"), ("vue", "<style>", "css"), ("vue", "x", "block"),
])
def test_content_types(spark, language, text, kind):
    df = files(spark, ("f", language, text))
    assert df.select(cut.content_type(cut.split_lines(F.col("text")), F.col("language"))).first()[0] == kind


def test_every_filled_line_is_in_exactly_one_chunk(spark):
    from lumenseek.catalog import tables as t
    from conftest import SF
    src = t.source_files(spark, SF)
    rows = chunk_files(src, timestamp=0)
    counted = rows.groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    joined = src.join(counted, "file_path", "left").select("text", "spans").collect()
    for r in joined:
        lines, seen = r.text.split("\n"), [0] * (r.text.count("\n") + 1)
        for s in r.spans or []:
            for k in range(s.start_line - 1, s.end_line):
                seen[k] += 1
        assert max(seen) <= 1
        assert all(n == 1 for n, line in zip(seen, lines) if line.strip())


def test_diagnostic_kinds(spark):
    row = top_level_kinds(scan_syntax(files(spark, ("f.ts", "ts", "import a\nclass B {}\n")))).first()
    assert [(k.line, k.kind) for k in row.kinds] == [(0, "import_statement"), (1, "class_declaration")]


LABELLED = [
    ("nested template", "const a = `x ${b ? `{` : ''} y`;\nfunction f() {\n}\nclass A {\n}\n", ["Variable", "Function", "Class"]),
    ("template in a template", "const a = `a ${ `b ${ `c ${'}'}` } {` } d`;\nclass A {\n}\n", ["Variable", "Class"]),
    ("regex after return", "function f(s) {\n  return /[{(]/.test(s);\n}\nfunction g() {\n}\nclass A {\n}\n",
     ["Function", "Function", "Class"]),
    ("regex after an arrow", "const f = s => /\\{/.test(s);\nfunction g() {\n}\nclass A {\n}\n", ["Function", "Function", "Class"]),
    ("division", "const a = b / c;\nconst d = (e) / 2 / f;\nclass A {\n}\n", ["Variable", "Variable", "Class"]),
    ("braces on their own lines", "class A\n{\n  run()\n  {\n  }\n}\nfunction f()\n{\n  function g() {\n  }\n}\n",
     ["Class", "Function", "Function", "Function"]),
    ("unknown literal", "if (x) /{/.test(y);\nfunction f() {\n  return 1;\n}\nexport class A {\n  run() {\n  }\n}\n",
     ["Function", "Export", "Function"]),
    ("generator", "function* g() {\n}\nfunction f() {\n}\n", ["Function"]),
]


@pytest.mark.parametrize("name, code, labels", LABELLED, ids=[c[0] for c in LABELLED])
def test_lexer_keeps_the_rest_of_the_file(spark, name, code, labels):
    from lumenseek.operators.syntax import scan_syntax
    df = spark.createDataFrame([("a.ts", "ts", code)], "file_path string, language string, text string")
    assert [p.label for p in scan_syntax(df).first().points] == labels


def test_script_on_one_line(spark):
    from lumenseek.operators.syntax import scan_syntax
    code = "<template>\n</template>\n<script>const a = 1;</script>\n<script setup>\nfunction f() {\n}\nlet b = 2;</script>\n<style>\n</style>\n"
    df = spark.createDataFrame([("a.vue", "vue", code)], "file_path string, language string, text string")
    found = sorted((p.line, p.label) for p in scan_syntax(df).first().points)
    assert found == [(0, "Template"), (2, "Script"), (2, "Variable"), (3, "Script"), (4, "Function"), (6, "Variable"), (7, "Style")]


def test_comment_lifting_is_linear(spark):
    import time

    from lumenseek.plans.chunking import chunk_files

    def seconds(lines):
        text = "".join(f"// note {i}\nconst v{i} = {i};\n" for i in range(lines))
        df = spark.createDataFrame([("a.ts", "ts", text)], "file_path string, language string, text string")
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            chunk_files(df, timestamp=0).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(100)
    small, large = seconds(2000), seconds(4000)
    assert large <= 3 * small + 1, (small, large)


UNITS = [
    ("two statements", "ts", "const a = 1; function b() {}\n", [(0, "Variable"), (0, "Function")], []),
    ("one-line class", "ts", "class A { run() { return 1; } stop() {} declared(a: number): void; }\n",
     [(0, "Class"), (0, "Function"), (0, "Function")], []),
    ("minified", "js", "describe('x', () => { it('y', () => { a(); b(); }); });function z(){return 1}class Q{m(){} n(){}}var k=function(){a()};",
     [(0, "Function"), (0, "Function"), (0, "Class"), (0, "Function"), (0, "Function"), (0, "Function")], []),
    ("headers and types", "ts", "for (let i = 0; i < n; i++) { go(); }\nif (a) { b(); } else { c(); }\nconst g = ({a, b}) => a; let x = {a: 1} as const;\n"
     "type T = { a: string; b: number }; interface I { m(): void; n: string }\n",
     [(2, "Function"), (2, "Variable"), (3, "Type Alias"), (3, "Interface")], []),
    ("imports on a line", "ts", "import { a } from 'a'; import b from 'b'; export { c };\n", [(0, "Import"), (0, "Import"), (0, "Export")], []),
    ("object on a line", "ts", "const o = { m() { return 1; }, n: 2 }; function f() { return () => 1; }\n",
     [(0, "Variable"), (0, "Function"), (0, "Function"), (0, "Function")], []),
    ("decorators", "ts", "@Component({\n  selector: 'x',\n  template: `\n<p>`,\n})\nexport class A {\n  @Input() a: string;\n  @HostListener('x', [\n"
     "    'y',\n  ])\n  onX() {\n  }\n}\n@Injectable()\nclass B {}\n", [(5, "Export"), (10, "Function"), (14, "Class")],
     [0, 1, 2, 3, 4, 7, 8, 9, 13]),
    ("bound markup", "tsx", "const M = <div>\n  <p>\n    x\n  </p>\n</div>;\nfunction f() {}\n", [(0, "Variable"), (0, "JSX"), (1, "JSX"), (5, "Function")], []),
    ("markup in parentheses", "tsx", "const N = (\n  <div>\n    <p>\n   a\n   </p>\n  </div>\n);\nclass Z {}\n", [(0, "Variable"), (1, "JSX"), (7, "Class")], []),
    ("bare markup", "jsx", "<div>\n  <section>\n    <p>\n b\n </p>\n    <i/>\n  </section>\n</div>;\nlet a = 1;\n", [(0, "JSX"), (1, "JSX"), (2, "JSX"), (8, "Variable")], []),
    ("markup as argument", "tsx", "root.render(\n  <App>\n    <X />\n  </App>\n);\nexport const E = <b>\n  {x && <i/>}\n</b>;\n", [(1, "JSX"), (5, "Export"), (5, "JSX")], []),
    ("no markup", "tsx", "const id = <T,>(a: T) => a;\nconst m = new Map<string, A>();\nclass Z {}\n", [(0, "Function"), (1, "Variable"), (2, "Class")], []),
    ("rules on a line", "css", ".a{b:c}.d{e:f} @media print{.x{y:z}.q{r:s}}.g{}\n.h {\n}\n",
     [(0, "Rule"), (0, "Rule"), (0, "Media Query"), (0, "Rule"), (1, "Rule")], []),
]


@pytest.mark.parametrize("name, language, code, found, noted", UNITS, ids=[u[0] for u in UNITS])
def test_statements_are_units_whatever_the_lines(points, name, language, code, found, noted):
    assert points(code, language) == (found, noted)


def test_decorators_over_lines_stay_with_their_class(chunks):
    text = "const a = 1;\n@Part({\n  x: 1,\n})\nclass A {\n  @Bound([\n    1,\n  ])\n  run() {\n  }\n}\n"
    assert chunks(text) == [(1, 1, "variable"), (2, 5, "class"), (6, 12, "function")]


def test_long_lines_take_linear_time(spark):
    import time

    def seconds(n):
        code = "".join(f"function f{i}(a){{return g((a)+(({i})))}}" for i in range(n))
        start = time.perf_counter()
        assert len(scan_syntax(files(spark, ("f", "js", code))).first().points) == n
        return time.perf_counter() - start

    seconds(10)
    small, large = seconds(1000), seconds(2000)
    assert large <= 3 * small + 1, (small, large)


def brute_merge(sizes, floor):
    taken = []
    for i, n in enumerate(sizes):
        joined = i > 0 and sizes[i - 1] < floor and not taken[i - 1]
        taken.append(joined or (0 < i == len(sizes) - 1 and n < floor))
    out = []
    for i, n in enumerate(sizes):
        if taken[i]:
            out[-1] += n
        else:
            out.append(n)
    return out


def test_small_pieces_join_like_brute_force(spark):
    import random
    rng = random.Random(4)
    cases = [[rng.choice([1, 2, 3, 9]) for _ in range(n)] for n in list(range(1, 12)) * 6 + [200]]
    made = [([(sum(sizes[:i]), None, ["x"] * n) for i, n in enumerate(sizes)],) for sizes in cases]
    df = spark.createDataFrame(made, "p array<struct<start:int,label:string,lines:array<string>>>")
    got = [[len(m.lines) for m in r[0]] for r in df.select(cut.merge_small(F.col("p"), 3)).collect()]
    assert got == [brute_merge(sizes, 3) for sizes in cases]


@pytest.mark.parametrize("form", ["merge", "compat"])
def test_piece_steps_take_linear_time(spark, form):
    import time

    def seconds(n):
        df = spark.range(1).select(
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
                (i * 2).cast("int").alias("start"), F.lit("Function").alias("label"), F.array(F.lit("a"), F.lit("b")).alias("lines"))).alias("p"),
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
                (i * 2).cast("int").alias("line"), F.lit("Function").alias("label"))).alias("b"))
        step = cut.merge_small(F.col("p"), 4) if form == "merge" else cut.relabel_at_running_starts(F.col("p"), F.col("b"))
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            assert df.select(F.size(step)).first()[0] == (n // 2 if form == "merge" else n)
            best = min(best, time.perf_counter() - start)
        return best

    seconds(100)
    small, large = seconds(20_000), seconds(40_000)
    assert large <= 3 * small + 1, (small, large)


def test_steps_build_an_array_once(spark):
    """An array that is laid beside its own neighbours is bound first, not built again for each mention."""
    tags = str(dict(syntax._scan_steps(False))["_tags"])
    assert tags.count("regexp_count") == 2
    points = str(cut.first_per_line(cut.group_imports(F.col("points"))))
    assert points.count("array_sort") == 1


def test_line_cuts_are_found_without_looking_behind_everywhere(spark):
    """A line with nothing to cut costs about as much as a search for the characters of a cut."""
    import time

    line = spark.range(400).select(F.concat(F.lit("x"), F.repeat(F.lit("word a1 "), 4000), F.col("id").cast("string")).alias("line")).cache()
    line.count()

    def seconds(pattern: str) -> float:
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            assert line.where(F.col("line").rlike(pattern)).count() == 0
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(syntax._CUTS) < 4 * seconds("[{};]") + 0.1
