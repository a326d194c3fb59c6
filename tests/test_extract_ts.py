from codeatlas.functions.tslex import FILL, cuts, scan, scan_block
from codeatlas.operators import extract_ts as xt
from tests.fixtures import source_files, ts_project


def test_ts_elements_fixture(spark):
    el = xt.ts_elements(ts_project(spark)).orderBy("path", "elem_ord").collect()
    got = [(r.path, r.elem_ord, r.name, r.type, r.line, r.signature, r.exported) for r in el]
    assert got == [
        ("src/index.ts", 1, "checkout", "function", 3, "checkout(lines: number[])", True),
        ("src/index.ts", 2, "Cart", "class", 8, "class Cart", True),
        ("src/money.ts", 1, "addTax", "function", 3, "addTax(amount: number, rate: number)", True),
        ("src/money.ts", 2, "_half", "function", 7, "_half(x: number)", False),
        ("src/money.ts", 3, "roundTo", "function", 9, "roundTo(amount: number): number", True),
        ("src/money.ts", 4, "CURRENCY", "variable", 1, None, True),
    ]


def test_ts_edges_fixture(spark):
    e = xt.ts_edges(ts_project(spark)).orderBy("src_path", "edge_ord").collect()
    got = [(r.src_path, r.from_element, r.type, r.dst_path, r.to_element) for r in e]
    assert got == [
        ("src/index.ts", None, "import", "src/money.ts", "addTax"),
        ("src/index.ts", None, "import", "src/money.ts", "roundTo"),
        ("src/index.ts", "checkout", "call", "src/index.ts", "report.send"),
        ("src/index.ts", "checkout", "call", "src/index.ts", "cart.sum"),
        ("src/index.ts", None, "call", "src/index.ts", "addTax"),
        ("src/index.ts", None, "call", "src/index.ts", "roundTo"),
        ("src/money.ts", "addTax", "call", "src/money.ts", "roundTo"),
    ]


SRC = '''import Def, { a as b, type T } from "./lib.js";
import * as ns from './ns';
import './side';
import { x } from 'pkg';
/** First.
 * @deprecated */
/** Kept doc.
 * second line
 * @param q */
export default class Widget<T> extends Base<T> implements IA, IB<X, Y> {
  run(q: string) { return helper(q); }
}
export function outer(a = "(", { p, q }: Opts): Promise<void> {
  const s = `${inner(1)} }`;
  function inner(n) { return deep(n) + new Thing(); }
  if (s) { tail(); }
  return Promise.resolve();
}
export const A = 1, { m, n } = obj, C = f(1, 2);
interface Shape { area(): number; }
export type Id = string | number;
export enum Color { Red }
'''


def test_ts_rules(spark):
    src = source_files(spark, [("p", "src/w.ts", SRC), ("p", "src/lib.ts", "export const v = 1;")])
    el = {r.name: r for r in xt.ts_elements(src).where("path = 'src/w.ts'").collect()}
    assert el["Widget"].signature == "class Widget extends Base<T>"
    assert el["Widget"].doc_comment == "Kept doc.\nsecond line"
    assert el["outer"].signature == 'outer(a = "(", { p, q }: Opts): Promise<void>'
    assert {el["A"].type, el["C"].type, el["{ m, n }"].type} == {"variable"}
    assert (el["Shape"].type, el["Shape"].exported) == ("interface", False)
    assert (el["Id"].type, el["Color"].type) == ("type", "enum")
    assert "inner" not in el  # nested function declarations are not top-level elements
    kinds = [r.type for r in xt.ts_elements(src).where("path = 'src/w.ts'").orderBy("elem_ord").collect()]
    assert kinds == ["function", "class", "interface", "type", "enum", "variable", "variable", "variable"]
    e = xt.ts_edges(src).where("src_path = 'src/w.ts'").orderBy("edge_ord").collect()
    imports = [(r.dst_path, r.to_element) for r in e if r.type == "import"]
    assert imports == [("src/lib.ts", "a"), ("src/lib.ts", "T"), ("src/lib.ts", "default"), ("pkg", "x")]
    inh = [(r.type, r.from_element, r.to_element) for r in e if r.type in ("extends", "implements")]
    assert inh == [("extends", "Widget", "Base<T>"), ("implements", "Widget", "IA"), ("implements", "Widget", "IB<X, Y>")]
    calls = [(r.from_element, r.to_element) for r in e if r.type == "call"]
    assert calls == [(None, "helper"), ("outer", "inner"), ("inner", "deep"), ("outer", "tail"),
                     ("outer", "Promise.resolve"), (None, "f")]


def test_resolution_index_and_js_swap(spark):
    src = source_files(spark, [
        ("p", "src/a.ts", "import { x } from './dir';\nimport { y } from './b.js';\nimport { z } from '../up';"),
        ("p", "src/dir/index.tsx", "export const x = 1;"),
        ("p", "src/b.ts", "export const y = 1;"),
        ("p", "up.ts", "export const z = 1;"),
    ])
    e = xt.ts_edges(src).where("type = 'import'").orderBy("edge_ord").collect()
    assert [(r.to_element, r.dst_path) for r in e] == [("x", "src/dir/index.tsx"), ("y", "src/b.ts"), ("z", "up.ts")]


def test_skeletons_keep_length_and_shape():
    src = "const s = '{'; // {\nconst r = /}/g; const t = `a${f('(')}b`, u = { v: [1, 2] };\n"
    statements, calls = scan(src)
    assert all(len(raw) == len(skeleton) and src[start:start + len(raw)] == raw for _, start, _, raw, skeleton, _, _ in statements)
    assert [s[4].replace(FILL, ".") for s in statements] == ["const s = '.'", "const r = /..g", "const t = `.${......}.`, u = {...........}"]
    assert calls == [("f", None)]


def test_class_headers_on_one_line_or_several(spark):
    src = source_files(spark, [("p", "a.ts", "export class A { run() { return 1; } }\nclass B extends Base { x = 1; }\n"
                                             "class C\n  extends D<X>\n  implements I, J {\n}\nconst k = class { };\nexport default class { }\n")])
    el = [(r.name, r.line, r.signature, r.exported) for r in xt.ts_elements(src).where("type = 'class'").orderBy("elem_ord").collect()]
    assert el == [("A", 1, "class A", True), ("B", 2, "class B extends Base", False), ("C", 3, "class C extends D<X>", False),
                  ("<anonymous>", 8, "class <anonymous>", True)]
    inh = [(r.type, r.from_element, r.to_element) for r in xt.ts_edges(src).where("type in ('extends', 'implements')").orderBy("edge_ord").collect()]
    assert inh == [("extends", "B", "Base"), ("extends", "C", "D<X>"), ("implements", "C", "I"), ("implements", "C", "J")]


def test_export_lists_mark_declarations(spark):
    src = source_files(spark, [("p", "a.ts", "function hid() { }\nfunction own() { }\nconst v = 1;\nclass K { }\nexport { hid, v as w };\n"
                                             "export { other } from './b';\nexport default K;\n")])
    assert {r.name: r.exported for r in xt.ts_elements(src).collect()} == {"hid": True, "own": False, "v": True, "K": True}


def test_generic_and_arrow_calls_and_unnamed_callers(spark):
    src = source_files(spark, [("p", "a.ts", "export default function () { inside(); }\nfunction named() { useState<string>(''); make<Map<A, B>>(1); }\n"
                                             "const go = async () => { tail(); };\nconst t = new Box<number>(1);\n")])
    calls = [(r.from_element, r.to_element) for r in xt.ts_edges(src).where("type = 'call'").orderBy("edge_ord").collect()]
    assert calls == [(None, "inside"), ("named", "useState"), ("named", "make"), (None, "tail")]


def test_edges_go_file_by_file(spark):
    src = source_files(spark, [("p", "b.ts", "import { x } from './c';\nf();\n"), ("p", "a.ts", "import { y } from './c';\ng();\n")])
    got = [(r.edge_ord, r.src_path, r.type) for r in xt.ts_edges(src).orderBy("edge_ord").collect()]
    assert got == [(1, "a.ts", "import"), (2, "a.ts", "call"), (3, "b.ts", "import"), (4, "b.ts", "call")]


def test_several_declarators(spark):
    src = source_files(spark, [("p", "a.ts", "const p = 1,\n  q = f(2, 3)\nconst a = 1; let b: Map<K, V> = x;\nexport const { m, n } = o, [u] = w;\n"
                                             "for (const i of xs) { const inner = 1; }\nconst enum E { A }\nvar long =\n  1 +\n  2, last\nif (x) { y(); }\nlet z\n")])
    got = [(r.name, r.line, r.exported) for r in xt.ts_elements(src).where("type = 'variable'").orderBy("elem_ord").collect()]
    assert got == [("p", 1, False), ("q", 2, False), ("a", 3, False), ("b", 3, False), ("{ m, n }", 4, True), ("[u]", 4, True),
                   ("long", 7, False), ("last", 9, False), ("z", 11, False)]


def test_scanner_survives_any_text_and_stays_linear():
    import random
    import time

    random.seed(1)
    tokens = ["function", "class", "const", "export", "default", "import", "type", "interface", "enum", "async", "a", "x.y", "(", ")", "{", "}", "[", "]", "<", ">", ",", ";", ":", "=", "=>",
              "'s'", '"d"', "`t`", "`${", "`", "/", "//c\n", "/* c */", "/** d */", "\n", "@", "?.", "...", "extends", "implements", "new", "case", "as", "1"]
    for _ in range(1500):
        src = " ".join(random.choice(tokens) for _ in range(random.randint(1, 50)))
        for _, start, _, raw, skeleton, _, _ in scan(src)[0]:
            assert len(raw) == len(skeleton) and src[start:start + len(raw)] == raw, src
    for text in ("{('x',", "function f(){", "a < b ", "const q = [{a: 'b', c: [1]},"):
        took = []
        for n in (4_000, 32_000):
            at = time.perf_counter()
            scan(text * n)
            took.append(time.perf_counter() - at)
        assert took[1] < 30 * took[0] + 1, text


def elements_of(spark, text, path="a.ts"):
    rows = xt.ts_elements(source_files(spark, [("p", path, text)])).orderBy("elem_ord").collect()
    return [(r.name, r.type, r.line, r.signature) for r in rows]


def edges_of(spark, text, *types):
    rows = xt.ts_edges(source_files(spark, [("p", "a.ts", text)])).orderBy("edge_ord").collect()
    return [(r.type, r.from_element, r.to_element) for r in rows if r.type in types]


def test_declarators_beside_comments_literals_and_comparisons(spark):
    text = ("const u = 1 // see x, y\nconst r = /a,b/, w = 3\nconst s = 1, /* x, y */ t = 2\nconst f = (x) => x < 3, g = 5\n"
            "const k = 's it\\\\', z = 2\nconst m = new Map<string, number>(), n = v as Map<K, V>, o = 1\nconst first = 1\n/* " + "c" * 5000 + " */\n, second = 2\n"
            "const " + " " * 500 + "enum E { X }\n")
    got = elements_of(spark, text)
    assert [(n, line) for n, t, line, _ in got if t == "variable"] == [
        ("u", 1), ("r", 2), ("w", 2), ("s", 3), ("t", 3), ("f", 4), ("g", 4), ("k", 5), ("z", 5), ("m", 6), ("n", 6), ("o", 6), ("first", 7), ("second", 9)]
    assert [n for n, t, _, _ in got if t == "enum"] == ["E"]


def test_class_headers_with_calls_and_object_types(spark):
    text = ("export class A extends mixin(B, C) implements I {\n  run() { go(); }\n}\nclass D extends Base<{ a: string }> {\n}\n"
            "export abstract class G<T extends { x: 1 }>\n  extends ns.Base<T, U>\n  implements I<A, B>, J { }\n@Dec({ s: 1 })\nexport class H { }\nexport class { }\n")
    assert elements_of(spark, text) == [
        ("A", "class", 1, "class A extends mixin(B, C)"), ("D", "class", 4, "class D extends Base<{ a: string }>"),
        ("G", "class", 6, "class G extends ns.Base<T, U>"), ("H", "class", 9, "class H"), ("<anonymous>", "class", 11, "class <anonymous>")]
    assert edges_of(spark, text, "extends", "implements") == [
        ("extends", "A", "mixin(B, C)"), ("implements", "A", "I"), ("extends", "D", "Base<{ a: string }>"), ("extends", "G", "ns.Base<T, U>"),
        ("implements", "G", "I<A, B>"), ("implements", "G", "J")]
    assert edges_of(spark, text, "call") == [("call", None, "mixin"), ("call", None, "go"), ("call", None, "Dec")]


def test_function_heads(spark):
    text = ("function f(): { d: string } { return go(); }\nfunction g<T extends { a: 1 }, U = () => void>(x: Map<K, V> = make<A, B>(1), cb: (a: string) => void): Promise<{ a: 1 }> { inner(); }\n"
            "function over(a: string): void\nfunction over(a: any) { last(); }\nfunction h(): x is { a: 1 } { return deep(); }\nfunction k(a,\n  b = (1, 2),\n) { }\n")
    assert [(n, s) for n, _, _, s in elements_of(spark, text)] == [
        ("f", "f(): { d: string }"), ("g", "g(x: Map<K, V> = make<A, B>(1), cb: (a: string) => void): Promise<{ a: 1 }>"),
        ("over", "over(a: string): void"), ("over", "over(a: any)"), ("h", "h(): x is { a: 1 }"), ("k", "k(a, b = (1, 2))")]
    assert edges_of(spark, text, "call") == [("call", "f", "go"), ("call", "g", "make"), ("call", "g", "inner"), ("call", "over", "last"), ("call", "h", "deep")]


def test_types_on_one_line_and_optional_calls(spark):
    text = "type V<T = string> = T\ninterface A1 { foo(x): string } interface B1 { }\nfoo.bar?.(1)\na?.b(2); x.y.z(3); a!.c(4); p()()\ntype = 5\n"
    assert [(n, t) for n, t, _, _ in elements_of(spark, text)] == [("A1", "interface"), ("B1", "interface"), ("V", "type")]
    assert edges_of(spark, text, "call") == [("call", None, "foo.bar"), ("call", None, "x.y.z"), ("call", None, "p")]


def test_members_are_no_calls(spark):
    text = ("class C {\n  constructor() { super(1); }\n  private async foo<T>(a: T): Promise<void> { bar(a) }\n  z = init(2)\n  get k() { return kk() }\n  *gen() { }\n}\n"
            "const o = { foo(x) { bar(x) }, async baz() { return qux() }, k: f(1), [c()]: 1 };\nswitch (x) { case 1: { one(); } default: two(); }\n"
            "function* gen() { yield g1(); return class { m() { n1() } } }\nexport const t = `a ${f(`b ${g(1)}`)} } {`;\nimport('dyn');\n")
    assert [(a, b) for _, a, b in edges_of(spark, text, "call")] == [
        (None, "super"), (None, "bar"), (None, "init"), (None, "kk"), (None, "bar"), (None, "qux"), (None, "f"), (None, "c"), (None, "one"), (None, "two"),
        ("gen", "g1"), ("gen", "n1"), (None, "f"), (None, "g"), (None, "import")]


def test_imports_resolve_to_files_that_are_not_scanned(spark):
    src = source_files(spark, [("p", "src/a.ts", "import data from './data.json';\nimport { x } from './vendor/lib';\nimport { y } from './none';\n")])
    tree = spark.createDataFrame([("p", "src/a.ts"), ("p", "src/data.json"), ("p", "src/vendor/lib.js")], "project string, path string")
    got = [(r.dst_path, r.to_element) for r in xt.ts_edges(src, files=tree).orderBy("edge_ord").collect()]
    assert got == [("src/data.json", "default"), ("src/vendor/lib.js", "x"), ("./none", "y")]


PIECES = ["export function f(a: string): void { go(a); }", "class A extends B { m() { run(); } }", "const x = 1, y = (a) => a < 3", "let t = `a ${f(1)}", "`", "/* open", "*/", "/** Doc. */", "{", "}", "(", ")",
          "import { a } from './a'", "export default K", "export abstract class Head<T> extends Foo.Bar<T>", "const z =", "@Dec()", "'un\\", "foo(", "type T = { a: 1 }", "interface I { }", "export { x }", "a = 1", "// c", "return"]


def test_blocks_read_on_their_own_give_the_rows_of_one_pass():
    import random

    random.seed(2)
    alone = 0
    for _ in range(1500):
        src = "\n".join(random.choice(PIECES) for _ in range(random.randint(2, 14)))
        statements, calls = scan(src)
        for at in cuts(src, 1)[1:]:
            s, c, whole = scan_block(src[:at])
            if whole:
                alone += 1
                more, further, _ = scan_block(src[at:])
                lines = src[:at].count("\n")
                assert s + [(kind, start + at, line + lines, *rest) for kind, start, line, *rest in more] == statements and c + further == calls, src
    assert alone > 500


def test_long_texts_are_read_in_blocks(spark):
    """Blocks of any size, some of which end inside a comment, template or class, give the rows of one pass."""
    import random

    random.seed(4)
    rows = [("p", f"f{k}.ts", "\n".join(random.choice(PIECES) for _ in range(40))) for k in range(12)]
    rows += [("p", "hot.ts", "\n".join(f"export function f{k}(a: M<K, V>): void {{ g{k}(a); }}\nexport class C{k} extends D {{\n  m() {{ return h{k}(); }}\n}}" for k in range(300))),
             ("p", "open.ts", "const t = `\n" + "export const a = 1\n" * 60), ("p", "empty.ts", ""), ("p", "none.ts", None)]
    src = source_files(spark, rows)
    line = lambda r: (r.path, [(s.kind, s.line, s.raw, s.skeleton, s.doc, s.top) for s in r.statements], [tuple(c) for c in r.calls])
    whole = sorted(map(line, xt.scanned(src).collect()))
    for size in (30, 700):
        assert sorted(map(line, xt.scanned(src, size).collect())) == whole, size
