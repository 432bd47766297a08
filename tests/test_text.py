"""Which quoted names of code are values: made-up programs whose values are known by how they were made."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text as T

NAME = st.sampled_from("ant bee cow doe elk fox gnu hen ibex jay".split())
QUOTE = st.sampled_from(["'", '"'])


@st.composite
def pieces(draw):
    """(line of code, names of it that are values)."""
    a, b, q = draw(NAME), draw(NAME), draw(QUOTE)
    return draw(
        st.sampled_from(
            [
                (f"const v = {q}{a}{q};", {a}),
                (f"call({q}a//b{q}, {q}{a}{q}); // {q}{b}{q}", {a}),
                (f"call({q}x/*y{q}); const w = {q}{a}{q}; /* it's {q}{b}{q} */", {a}),
                (f"/* {q}{a}{q} */ const z = `{b}`;", {b}),
                (f"/* don't\n {q}{a}{q} */", set()),
                (f"const u = cond ? {q}{a}{q} : {q}{b}{q};", {a, b}),
                (f"const o = {{ k: {q}{a}{q}, {q}{b}{q}: 1 }};", {a, b}),
                (f"function f(n: {q}{a}{q}, m: {q}{b}{q}): {q}{a}{q} {{ return n; }}", set()),
                (f"function g(n: Kind = {q}{a}{q}) {{}}", {a}),
                (f"const h = (n: {q}{a}{q}) => n;", set()),
                (f"let i: {q}{a}{q} | {q}{b}{q} = {q}{b}{q};", {b}),
                (f"const j = use<{q}{a}{q}>({q}{b}{q});", {b}),
                (f"import k from {q}{a}{q};", set()),
                (f"export * from {q}{a}{q};", set()),
                (f"type L = {q}{a}{q} | {q}{b}{q};", set()),
                (f"interface M {{ k: {q}{a}{q}; }}", set()),
                (f"const n = s.replace(/'/g, {q}{a}{q});", {a}),
                (f"const p = {q}{a}{q} as const;", {a}),
                (f"go(x, {{ url: {q}http://h/{q}, name: {q}{a}{q} }});", {a}),
                (f"const r = `${{n}}_{a}`;", set()),
                (f"type R = {q}{a}{q} | {q}{b}{q}", set()),
                (f"type S<X = {q}{a}{q}> = X extends {q}{b}{q} ? {q}{a}{q} : {{ k: {q}{b}{q} }}", set()),
                (f"register({q}{a}{q})", {a}),
                (f"async function t() {{ return {q}{a}{q} }}", {a}),
                (f"enum U {{ A = {q}{a}{q} }}", {a}),
                (f"function v(k: {q}{a}{q}): asserts k is {q}{b}{q}", set()),
                (f"class W extends X<{q}{a}{q}> {{\n  kind: {q}{a}{q} = {q}{b}{q}\n  m(x?: {q}{a}{q}) {{ return {q}{b}{q} }}\n}}", {b}),
                (f"const y = ({{ k = {q}{a}{q} }}: {{ k?: {q}{b}{q} }}): Promise<{q}{b}{q}> => go(k)", {a}),
                (f"switch (z) {{ case {q}{a}{q}: return {q}{b}{q}; default: q = {q}{b}{q} }}", {a, b}),
                (f"const aa = (<Text>It's {{x ? {q}{a}{q} : {q}{b}{q}}}, so: don't</Text>)", {a, b}),
                (f"const bb = (<Row>\n  Kind: {{{q}{a}{q}}}\n  <Icon name={q}{b}{q} /></Row>)", {a, b}),
                (f"let cc = dd as Map<string, {q}{a}{q}>\nlet ee = {q}{b}{q} satisfies Kind", {b}),
                (f"export {{ ff }} from {q}{a}{q}", set()),
                (f"const gg = {{ class: {{ k: {q}{a}{q} }}, default: {q}{b}{q}, type: {q}{a}{q} }}", {a, b}),
                (f"const hh = <K extends {q}{a}{q}>(k: K) => {q}{b}{q}", {b}),
                (f"declare const ii: {q}{a}{q}", set()),
                (f"window.name = {q}{a}{q}", {a}),
                (f"see http://h/x {q}{a}{q}", {a}),
            ]
        )
    )


@pytest.fixture(scope="module")
def values(spark):
    """Programs to names, in one job each."""

    def run(programs):
        df = spark.createDataFrame(list(enumerate(programs)), "i int, code string")
        rows = df.select("i", T.value_literals(F.col("code"), F.lit("a.tsx")).alias("names")).collect()
        return [set(r["names"]) for r in sorted(rows)]

    return run


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pieces(), min_size=1, max_size=6), min_size=20, max_size=20))
def test_values_of_made_up_programs(values, programs):
    got = values(["\n".join(line for line, _ in p) for p in programs])
    for p, names in zip(programs, got):
        assert names == set().union(*(n for _, n in p)), p


@pytest.mark.parametrize(
    "code",
    [
        "type Kind = 'ant' | 'bee'\nasync function go() { return 'home'; }",
        "type Props = { a: number }\nregister('home')",
        "type K = string\nenum E { A = 'home' }",
        "function f() {\n type L = string\n return 'home'\n}",
        "type K = 'x'\nwindow.name = 'home'",
        "type K =\n  | 'ant'\n  | { k: 'bee' }\n\n  | 'cow'\nconst x = 'home'",
        "'use strict'\n'worklet'\nfunction g() {\n 'worklet';\n return <X name={'home'}/> }",
        "const [a, b] = useState<'ant' | { k: 'bee' }>('home')",
        "abstract class A { abstract m(): 'ant'; static p: 'bee' = 'home'; q!: 'cow'; r?: 'doe' }",
        "const f = a < b ? 'home' : x<y && z>w",
        "const x = <Foo.Bar\n  a={(v: 'ant') => v}\n  b>it's: {'home'}</Foo.Bar>",
    ],
)
def test_types_end_where_they_end(values, code):
    assert values([code]) == [{"home"}]


def test_comparisons_and_assertions_of_plain_files(spark):
    code = "const a = <Kind>'ant'\nconst b = (c: 'bee') => 'cow'\nconst d = i <n ? 'doe' : 'elk'"
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(T.value_literals(F.col("code"), F.lit("a.ts"))).first()[0] == ["ant", "cow", "doe", "elk"]


def test_long_strings_and_files_do_not_overflow(values):
    code = "const a = '" + "x\\n" * 3000 + "';\nconst b = `" + "Y" * 200_000 + "`;\n" + "const c = { k: 'ant', l: 'no no' }; // 'bee'\n" * 4000 + "type T = " + " | ".join(["'cow'"] * 2000) + ";\nconst d = 'doe';"
    assert values([code, "", None]) == [{"ant", "doe"}, set(), set()]


def test_numeric_references(spark):
    texts = ["&#105;nfo", "a&#x6e;t", "&#X6e;", "&#1234567;x", "&#9999999;", "&eacute;", "plain", "&#233;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", T.without_references(F.col("t"))).collect())]
    assert got == ["info", "ant", "&#X6e;", "&#1234567;x", "&#9999999;", "&eacute;", "plain", "�"]


def test_line_comments_go_and_lines_stay(spark):
    code = "a // 'x\n/* // y */ b = 'c//d'\n// e\nf"
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(T.without_line_comments(F.col("c"))).first()[0] == "a \n/* // y */ b = 'c//d'\n\nf"
