"""Small sources that are valid, and that aren't, by language."""

VALID_FORMS = {
"javascript": ["label: for (;;) { break label; }", "async function f(x) { for await (const y of x) { g(y); } }", "export * as ns from './x.js';", "const f = function* () { yield 1; };", "function* g() { yield* h(); }",
 "a.catch(e => {}).finally(() => 1);", "const { a, b: [c, d = 2], ...rest } = o;", "if (a) b(); else c();", "if (a) { b(); } else if (c) { d(); } else { e(); }", "do { x++; } while (x < 3);", "do x++; while (x < 3)",
 "try { a(); } catch { b(); } finally { c(); }", "class A extends B { #p = 1; static s = 2; static { x(); } get v() { return this.#p; } set v(x) {} async *it() {} [k]() {} constructor() { super(); } }",
 "const x = a ? b : c ? d : e;", "let s = `a ${b + `c ${d}`} e`;", "var r = /[/\"]+/g.test(x);", "switch (x) { case 1: a(); break; case 'b': { c(); } default: d(); }", "const f = async ({ a, b }) => { await a; };",
 "x = { a, b() { return 1; }, get c() { return 2; }, ['d']: 3, async e() {}, *g() {}, 'h-i': 4, ...rest };", "new Foo;\nnew a.b.C(1);", "delete a.b, void 0;", "a ??= b; c ||= d; e **= 2;", "import d, { x as y } from 'm';\nimport * as n from 'm';\nimport 'side';",
 "export default class { }\nexport { a as b };\nexport const c = 1;", "while (1) ;", "for (const k in o) if (k) f(k);", "if (a)\n  b()\nelse\n  c()", "let a = 1, b, c = [1, , 2];", "(function () { return 1; })();", "(() => {})();", "a = b\n++c", "throw new Error(`x`);", "const big = 10n, n = 1_000, h = 0xff;", "x = y.default.class.if;", "async () => { await import('x'); };", "var a = function () {}\nvar b = 2", "o = { if: 1, class: 2, default: 3 };", "f(...args, ...more);", "x = typeof a === 'b' && !(c in d);","return_ = a\n  ? b\n  : c;", "const g = (a, b = {}, ...c) => ({ a, b });", "x = [...a, ...b];", "if (a) return_; else { }", "var o = {\n  a: 1,\n  b: function () { return 2 },\n}", "a\n  .b()\n  .c();", "if (x) for (;;) y(); else z();","outer: while (true) { continue outer; }", "x = a\n  && b\n  || c"],
"typescript": ["type A<T> = T extends string ? 1 : { [K in keyof T]?: T[K] };", "abstract class A<T> implements B { private readonly x: number = 1; constructor(public a: string, private b?: number) { super(); } abstract f(): void; get y(): string { return ''; } }", "function f(this: Foo, a?: number, ...r: string[]): asserts a is number {}", "enum E { A = 1, B = 'x', C }", "declare module 'x' { export function f(): void; }", "let x = <T,>(a: T) => a;", "const y = a as unknown as B;", "let z = o!.p!;", "interface A extends B, C { (x: number): string; new (x: number): A; [k: string]: any; m?(): void; readonly p: 1 | 2; }", "function f(a: string): void;\nfunction f(a: number): void;\nfunction f(a: any) {}", "export type { A } from './a';", "namespace N.M { export const x = 1; }", "const f = async <T>(x: T): Promise<T> => { return x; };", "let t: [a: string, b?: number] = ['x'];", "type F = (a: number, b: string) => void;", "x = y satisfies Z;", "@dec()\nclass A { @input() name: string; }", "let u: string | null | undefined;", "for (const [k, v] of Object.entries(o)) { f(k as string, v); }", "export default function <T>(x: T): x is NonNullable<T> { return !!x; }", "type G = typeof x[number];", "let a: Array<{ b: number }> = [];", "import type { X } from 'y';", "const enum Z { A }", "type L = `a-${string}`;", "export abstract class Q {}", "let v = new Map<string, number[]>();", "private_ = 1;", "function g<T extends keyof U, U = {}>(x: T): U[T] { return null!; }", "declare const VERSION: string;", "if (a) { b(); } else { c(); }"],
"go": ["package a\nfunc f(x interface{}) {\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\tg(v)\n\tdefault:\n\t}\n}", "package a\nfunc f() {\n\tif v, ok := m[k]; ok {\n\t\tg(v)\n\t} else if !ok {\n\t}\n}", "package a\nvar x = a[1:2:3]", "package a\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n\t_ \"q\"\n)", "package a\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n\tD map[string][]int\n}", "package a\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\treturn 1, nil\n}", "package a\nfunc f() {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t\t_ = v\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tfor x {\n\t}\n}", "package a\nfunc f() {\n\tgo func() { g() }()\n\tdefer h.Close()\n\tselect {\n\tcase x := <-c:\n\t\tg(x)\n\tcase d <- 1:\n\tdefault:\n\t}\n}", "package a\nconst (\n\tA = iota\n\tB\n)", "package a\ntype I interface {\n\tF(int) error\n\tG\n}", "package a\nfunc Map[T any, U comparable](x []T, f func(T) U) []U {\n\treturn nil\n}", "package a\nvar x = []T{{1, 2}, {3, 4}}\nvar y = &T{A: 1, B: []int{1}}", "package a\nfunc f() {\nouter:\n\tfor {\n\t\tcontinue outer\n\t}\n}", "package a\nvar f = func(x int) int { return x }", "package a\ntype F func(int, string) (bool, error)", "package a\nfunc f() {\n\tx, y = y, x\n\ta.b[c]++\n\t*p = 3\n\tc <- 1\n\tv := <-c\n}", "package a\nvar (\n\tx int\n\ty, z = 1, 2\n)", "package a\nfunc f() {\n\tif err := g(); err != nil {\n\t\treturn\n\t}\n}", "package a\nfunc f() {\n\tg(\n\t\t1,\n\t\t2,\n\t)\n}", "package a\ntype A = B\ntype C[T any] struct{ x T }", "package a\nfunc f() {\n\tswitch {\n\tcase a > b:\n\t\tfallthrough\n\tcase c:\n\t}\n\tswitch x := g(); x {\n\tcase 1:\n\t}\n}", "package a\nvar a [3]int\nvar b chan<- int\nvar c <-chan int"],
"java": ["class A { int b[][] = new int[3][]; int[] c = {1, 2}; }", "class A { void f() { switch (x) { case 1 -> g(); case 2, 3 -> { h(); } default -> throw new E(); } } }", "class A { void f() { try { g(); } catch (A | B e) { h(); } finally { } } }", "class A { boolean f(Object o) { return o instanceof String s && s.isEmpty(); } }", "enum E { A(1) { int f() { return 1; } }, B(2); private final int x; E(int x) { this.x = x; } abstract int f(); }", "package a.b;\nimport static a.b.C.*;\nimport a.b.*;\npublic final class A<T extends B & C> extends D<T> implements E, F { }", "class A { @Override public <T> List<? super T> f(final T... x) throws E, G { return null; } }", "class A { static { x = 1; } { y = 2; } }", "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) { } for (String s : xs) g(s); while (true) { break; } do { x++; } while (x < 3); } }", "class A { Runnable r = () -> { }; F f = x -> x + 1; G g = (a, b) -> a * b; H h = A::new; I i = String::valueOf; }", "@interface X { String value() default \"a\"; int[] n() default {}; }", "record P(int x, int y) implements Q { P { if (x < 0) throw new E(); } }", "class A { int f() { return switch (x) { case 1 -> 2; default -> { yield 3; } }; } }", "class A { void f() { outer: for (;;) { continue outer; } synchronized (this) { } assert x > 0 : \"m\"; } }", "class A { int x = (int) y; String s = (String) o.get(0); Object o = new Object() { void g() { } }; }", "class A { void f() { try (R r = new R(); S s = t()) { } } }", "interface I { default void f() { } static int g() { return 1; } void h(); }", "class A { int[] x = new int[] {1, 2, 3}; int[][] y = {{1}, {2}}; }", "sealed interface S permits A, B { }", "class A { char c = '\\''; long l = 0xFFL; double d = 1e-3; String t = \"\"\"\n a \"b\"\n \"\"\"; }", "class A { void f() { if (a) b(); else if (c) { d(); } else e(); } }", "class A { Map<String, List<Integer>> m = new HashMap<>(); }", "class A { void f() { a.b().c(x -> { return x; }).d(); this.x = y ? z : w; } }", "@A(b = 1, c = {2, 3})\npublic class D { @E int f; }", "class A { class B { } enum C { X, Y } interface D { } }", "class A { void f() { int x = 1, y; final var z = 2; x += y << 2; } }", "class A { public static void main(String[] args) { System.out.println(args[0]); } }"],
"rust": ["fn f() { let v = \"1\".parse::<i32>().unwrap(); let w = Vec::<u8>::new(); }", "fn f() { 'outer: loop { break 'outer; } }", "macro_rules! m { ($x:expr) => { $x + 1 }; ($($y:tt)*) => {}; }", "fn f(x: i32) -> i32 { match x { 0..=9 => 1, 10.. => 2, A { b, .. } => 3, (_, ..) => 4, [a, .., z] => 5, x if x > 1 => { 6 } _ => 7 } }", "pub struct A<'a, T: Clone + 'a> where T: Debug { pub x: &'a T, y: Box<dyn Fn(i32) -> i32> }", "impl<T> Trait for A<T> { type X = u8; const N: usize = 1; fn f(&mut self, x: impl Into<String>) -> Result<(), E> { Ok(()) } }", "use std::{io::{self, Read}, fmt};\npub(crate) mod x;\nextern crate y;", "#[derive(Debug)]\npub enum E { A, B(i32, u8), C { x: u8 }, D = 3 }", "fn f() { let x = if a { 1 } else { 2 }; let Some(y) = z else { return; }; if let Some(w) = q { } while let Some(t) = s.pop() { } }", "async fn f() -> Result<u8, E> { g().await?; Ok(h(|x| x + 1, move |(a, b)| { a * b })) }", "const A: [u8; 3] = [0; 3]; static B: &str = \"x\";", "fn f() { let x: Vec<_> = a.iter().map(|&y| y as u8).filter(|z| !z.is_empty()).collect(); println!(\"{}\", x); vec![1, 2]; }", "trait T: U + V { fn f(&self); fn g(&self) -> u8 { 1 } }", "fn f() { for (i, x) in y.iter().enumerate() { continue; } for k in 0..10 { } }", "unsafe impl Send for A {}\nfn f<F>(x: F) where F: Fn(u8) -> u8 { unsafe { g(); } }", "type A = fn(u8) -> u8; type B = dyn Fn();", "fn f() { let A { x, y: (a, b), ref c } = d; let &mut e = g; *h = 1; i.0.j += 2; k = &mut l[1..]; }", "fn f() -> impl Iterator<Item = u8> + '_ { loop { } }", "fn f() { return; }\nmod t { use super::*; #[test] fn g() { assert_eq!(1, 2); } }", "fn f() { let s = r#\"a \"b\" c\"#; let c = 'x'; let b = b\"y\"; let l = 'a'; }", "fn f(x: &[u8]) -> Option<&str> { x.get(0).map(|_| \"a\") }", "fn f() { match x { Some(y) | Ok(y) => y, None => return, } }", "fn f() { a::b::<C>(d); <A as B>::c(); let x = A::<u8> { y: 1, ..Default::default() }; }", "pub fn f() { x.y = z; if a && b || !c { } else if d { } else { } }", "struct U; struct V(pub u8, String);"],
"python": ["a = [x for x in y if z]\n", "def f(a, /, b, *, c=1, **k) -> int:\n    return lambda x: x\n", "with a as b, c:\n    pass\n", "try:\n    a()\nexcept (A, B) as e:\n    pass\nelse:\n    b()\nfinally:\n    c()\n", "@d(1)\nclass A(B, metaclass=C):\n    x: int = 1\n", "match x:\n    case {'a': 1, **r} if r:\n        pass\n    case A(b=1) | [1, *_]:\n        pass\n    case _:\n        pass\n", "for i, (a, b) in e:\n    continue\nelse:\n    pass\n", "while x: y()\n", "x = yield\ny = await_ if a else b\n", "print(f'{a!r:>{b}}', *c, **d)\n", "del a[1:2, ::3], b\n", "global x\n", "async def f():\n    async with a:\n        async for b in c:\n            await d\n", "if (n := 1) > 0: pass\nelif x: pass\nelse: pass\n", "from . import (a as b,\n  c,)\n", "x = {1, 2} | {**a, 'b': 2} and not c is not d\n", "assert a, b\nraise A from b\n", "a, *b = c = d\n", "x = 'a' 'b' \\\n  'c'\n", "def f(): ...\n", "lambda *a, b=1, **c: (a, b)\n", "nonlocal_ = x[..., None]\n", "type X = int\n", "a @= b; c = d @ e\n"],
"json": ["{}", "[1, -2.5e3, true, null, \"x\\u00e9\"]", "{\"a\": {\"b\": [[], {}]}}", "3", "\"s\""],
}
INVALID_FORMS = {
"javascript": ["f(,a);", "x = [1 2];", "return_ {,}", "var o = {,};", "else { a(); }", "catch (e) { }", "f(a; b);", "x = [1;2];", "let = = 3;", "function (a) { }" , "if a { b(); }", "const x;y =", "class A { x = ; }", "a + ;", "for (x of) {}", "try { a(); }", "x = {a: 1 b: 2};", "x = [\n 1,\n 2\n 3,\n];", "import from 'x';", "let x: number = 1;", "f(a b);", "var 1a = 2;", "a ? b;", "while () { }", "if (a) { } else { } else { }", "new ;", "a..b;", "finally { }", "foo(a,, b);"],
"typescript": ["let x: = 3;", "f(,a);", "interface A { x: }", "enum { A }", "else { }", "class A { f( { } }", "const x = [1 2];", "function f(a: number b: string) {}", "catch (e) {}"],
"go": ["func f() {}", "package a\nfunc f( {\n}", "package a\nx := 1\nfunc {\n}", "package a\nfunc f() {\n\tif {\n\t}\n}", "package a\nvar x = [1, 2]int", "package a\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}", "package a\nfunc f() {\n\telse {\n\t}\n}", "package a\nfunc f() {\n\tg(,1)\n}", "package a\nfunc f() {\n\tx = \n}", "package a\nfunc f() {\n\ta b c\n}"],
"java": ["class A { void f() { x = 1 } }", "class A { int f( { } }", "class A { void f() { else { } } }", "class A { void f() { catch (E e) { } } }", "class { }", "class A { void f() { g(,1); } }", "class A { void f() { try { } } }", "class A { void f() { int = 3; } }", "class A { int x y; }", "class A { void f() { return 1 } }", "class A { void f() { if x { } } }", "import a.b"],
"rust": ["fn f() { let x = ; }", "fn f( { }", "fn f() { else { } }", "fn () { }", "fn f() { g(,1); }", "struct A { x u8 }", "fn f() { let = 3; }", "fn f() { a b; }", "impl { }", "fn f() { match { } }", "let x = 1"],
"python": ["def f(:\n    pass\n", "x = = 1\n", "if x\n    pass\n", "else:\n    pass\n", "try:\n    a()\n", "a b\n", "f(,a)\n", "x = [1 2]\n", "class A\n    pass\n", "  x = 1\n", "if x:\npass\n", "except A:\n    pass\n"],
"json": ["{a: 1}", "[1, 2,]", "{\"a\": 1,}", "{\"a\" 1}", "[1 2]", "{\"a\": }", "", "[,]", "{\"a\": 1} {\"b\": 2}", "{'a': 1}", "[01]", "{\"a\": tru}", "{1: 2}", "{\"a\": 1 \"b\": 2}"],
}
