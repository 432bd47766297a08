from collections import defaultdict

import pytest

from loomwright.operators import usage

NAMES = "pin_drop flag tent bus ferry tram bridge tower castle beach peak cabin lake forest school clinic bakery market museum theatre fountain garden stadium harbor".split()
IMPORT = "import { Marker } from 'map-marks';\n"
#: Small sites of a travel guide. What each renders is worked out by hand in the tests below.
PROJECTS = {
    "legend": {
        "Legend.jsx": IMPORT
        + """const unused = ['tent', 'ferry'];
export function Legend() {
  return <ul>
    <li><Marker name='flag' /></li>
    <li><Marker filled name="bus" /></li>
    <li><Marker name={'tram'} filled={true} size={3} /></li>
  </ul>;
}"""
    },
    "stops": {
        "Stop.jsx": IMPORT
        + """export function Stop({ kind, late }) {
  const station = late ? 'tower' : 'bridge';
  return <Marker name={kind === 'sea' ? 'harbor' : kind === 'rail' ? station : 'bus'} filled={isOpen(kind)} />;
}"""
    },
    "trips": {
        "places.js": "export const PLACES = { north: { mark: 'peak', label: 'museum' }, south: { mark: 'beach', label: 'castle' } };\nexport const ROUTE = ['cabin', 'lake', 'forest'];",
        "Trip.jsx": IMPORT
        + """import { PLACES, ROUTE as WAY } from './places';
export const Trip = ({ at }) => <section>
  <Marker name={PLACES.north.mark} />
  <Marker name={PLACES[at].mark} filled />
  <Marker name={WAY[1]} />
  <Marker name={WAY[at]} variant="sharp" />
</section>;""",
    },
    "spelled": {
        "Town.jsx": """import { Marker as M } from 'map-marks';
import * as Marks from 'map-marks';
import { jsx } from 'react/jsx-runtime';
const Sign = M;
export const Town = () => <main>
  <M name="market" />
  <Marks.Marker name='museum' filled />
  <Sign name='theatre' />
  {jsx(M, { name: 'bakery', filled: true })}
  <Stranger name="castle" />
</main>;"""
    },
    "badges": {
        "parts/Badge.jsx": IMPORT + "export const Badge = ({ mark: glyph = 'fountain', on }) => <span><Marker name={glyph} filled={on} /></span>;",
        "parts/Spot.jsx": IMPORT + "import { forwardRef } from 'react';\nexport const Spot = forwardRef((p, ref) => <Marker {...p} variant='outlined' />);",
        "parts/Stack.jsx": "import { Badge } from './Badge';\nexport default function Stack({ top }) {\n  return <div><Badge mark={top} on={false} /><Badge on /></div>;\n}",
        "Board.jsx": """import { Badge } from './parts/Badge';
import { Spot } from './parts/Spot';
import Stack from './parts/Stack';
const caption = 'school';
export const Board = () => <div>
  <Badge mark="clinic" />
  <Spot name="garden" filled />
  <Stack top="stadium" />
</div>;""",
    },
    "kit": {
        "kit/marks.js": "export { Marker as Pin } from 'map-marks';",
        "kit/index.js": "export * from './marks';",
        "Page.jsx": "import { Pin } from './kit';\nexport const Page = () => <Pin name='pin_drop' filled={false} />;",
    },
    "untold": {
        "pick.js": "export function pick(day) { return day > 5 ? 'beach' : 'school'; }",
        "stock.js": "export const STOCK = [{ m: 'tent' }, { m: 'ferry' }];",
        "apart.js": "export const APART = 'castle';",
        "Week.jsx": IMPORT
        + """import { pick } from './pick';
import { STOCK } from './stock';
export const Week = ({ day }) => <ol>
  <Marker name={pick(day)} />
  {STOCK.map((s) => <Marker key={s.m} name={s.m} />)}
</ol>;""",
    },
    "idle": {"Idle.jsx": IMPORT + "export const Idle = ({ which }) => <Marker name={which} />;"},
    "odd": {"Odd.jsx": IMPORT + "export const Odd = () => <p><Marker name='lake' variant='sharp' /><Marker name='no_such_mark' /><Marker /></p>;"},
}


@pytest.fixture(scope="module")
def traced(spark):
    """All projects in one analysis, for no file of one imports from another: uses with their shapes, messages, number of sites, wrappers, files taken whole."""
    files = [(f"{p}/{f}", code) for p, fs in PROJECTS.items() for f, code in fs.items()]
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    r = usage.analyze(spark.createDataFrame(files, "path string, code string"), names, library="map-marks", component="Marker")
    shapes = defaultdict(set)
    for u in r.uses.collect():
        shapes[u["variant"], u["name"]].add(u["shape"])
    messages = {(d["path"], d["line"]): d["message"] for d in r.diagnostics.collect()}
    return {k: "".join(sorted(v)) for k, v in shapes.items()}, messages, r.sites, {w["component"] for w in r.wrappers.collect()}, {f["path"] for f in r.fallback_files.collect()}


def test_uses_worked_out_by_hand(traced):
    uses = traced[0]
    want = {
        "legend": {"flag": "d", "bus": "f", "tram": "f"},
        "stops": {"harbor": "df", "tower": "df", "bridge": "df", "bus": "df"},
        "trips": {"peak": "df", "beach": "f", "lake": "d"},
        "spelled": {"market": "d", "museum": "f", "theatre": "d", "bakery": "f"},
        "badges": {"clinic": "d", "stadium": "d", "fountain": "f"},
        "kit": {"pin_drop": "d"},
        "untold": {"beach": "d", "school": "d", "tent": "d", "ferry": "d"},
    }
    rounded = defaultdict(set)
    for project in want.values():
        for name, s in project.items():
            rounded[name] |= set(s)
    assert {n: s for (v, n), s in uses.items() if v == "rounded"} == {n: "".join(sorted(s)) for n, s in rounded.items()}
    assert {k: s for k, s in uses.items() if k[0] != "rounded"} == {("sharp", "cabin"): "d", ("sharp", "lake"): "d", ("sharp", "forest"): "d", ("outlined", "garden"): "f"}


def test_wrappers_and_what_is_said(traced):
    _, messages, _, wrappers, fallback = traced
    assert wrappers == {"Badge", "Spot", "Stack", "Idle"}
    assert fallback == {"untold/pick.js", "untold/stock.js"}
    assert "filled could not" in messages["stops/Stop.jsx", 4]
    assert "the result of a function call" in messages["untold/Week.jsx", 5] and "'s' could not be found" in messages["untold/Week.jsx", 6]
    assert "has no call sites" in messages["idle/Idle.jsx", 1]
    assert set(messages) == {("stops/Stop.jsx", 4), ("untold/Week.jsx", 5), ("untold/Week.jsx", 6), ("idle/Idle.jsx", 1)}


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("'a'", ["'a'"]),
        ("x ? 'a' : y ? 'b' : C", ["'a'", "'b'", "C"]),
        ("a && 'b'", ["a", "'b'"]),
        ("(x as any) ?? 'b'", ["x", "'b'"]),
        ("k === 'z' ? 'a' : 'b'", ["'a'", "'b'"]),
        ("{ a: 'x', b: c ? 'y' : 'z' }", ["{ a: 'x', b: c ? 'y' : 'z' }"]),
        ("T[k]?.icon", ["T[k]?.icon"]),
    ],
)
def test_branches(spark, expression, want):
    df = spark.createDataFrame([(expression,)], "e string")
    assert df.select(usage.branches(df.e)).first()[0] == want


def test_deep_wrappers_long_barrels_and_circles(spark):
    files = {
        "deep.tsx": IMPORT + "export const W0 = ({ name }) => <Marker name={name} />;\n" + "".join(f"export const W{i} = ({{ name }}) => <><W{i - 1} name={{name}} /><W{i - 1} name={{name}} /></>;\n" for i in range(1, 13)) + "export const A = () => <W12 name='tent' />;\n",
        "b0.ts": "export { Marker } from 'map-marks';\n",
        **{f"b{i}.ts": f"export * from './b{i - 1}';\n" for i in range(1, 6)},
        "far.tsx": "import { Marker } from './b5';\nexport const B = () => <Marker name='flag' />;\n",
        "circle.tsx": IMPORT + "export const R = ({ a, b }) => <><Marker name={a} /><R a={b} b='tower' /></>;\nexport const C = () => <R a='bus' b='tram' />;\n",
    }
    uses, messages = analyzed(spark, files)
    # Twelve levels of two calls each are 4,096 chains; a circle ends when it adds nothing.
    assert uses == {("rounded", n, "d") for n in ("tent", "flag", "bus", "tram", "tower")} and messages == {}


def analyzed(spark, files, names=NAMES):
    r = usage.analyze(spark.createDataFrame(list(files.items()), "path string, code string"), spark.createDataFrame([(n,) for n in names], "name string"), library="map-marks", component="Marker")
    return {tuple(x) for x in r.uses.collect()}, {(d["path"], d["line"]): d["message"] for d in r.diagnostics.collect()}


def passed_on():
    files = {
        "p/kit.tsx": IMPORT
        + """export const Item = ({ item, ...rest }) => <Marker name={item.marks.main} {...rest} />;
export const Row = ({ entry, look = 'sharp' }) => {
  const chosen = entry;
  return <Item item={chosen} variant={look} />;
};
export const Made = ({ kind, at }) => <Marker name={`${kind}_${at}`} />;
export const Half = ({ at }) => <Made kind={at} at='drop' />;
""",
        "p/page.tsx": """import { Row, Item, Made, Half } from './kit';
const TABLE = { a: { marks: { main: 'peak', other: 'cabin' } }, b: { marks: { main: 'lake' } } };
export const P = ({ k }) => <>
  <Row entry={TABLE.a} look='outlined' />
  <Row entry={TABLE[k]} />
  <Item item={{ marks: { main: 'beach' } }} filled />
  <Made kind='pin' at='drop' />
  <Half at='pin' />
</>;
""",
    }
    return files, {("outlined", "peak", "d"), ("sharp", "peak", "d"), ("sharp", "lake", "d"), ("rounded", "beach", "f"), ("rounded", "pin_drop", "d")}, {}


def shadowed():
    files = {
        "s/a.tsx": IMPORT
        + """const glyph = 'tent';
const s = 'castle';
export function A() {
  const glyph = 'flag';
  const parts = ITEMS.map((s) => <Marker name={s} filled />);
  if (x) {
    const glyph = 'bus';
    return <Marker name={glyph} />;
  }
  const inner = () => {
    const own = 'ferry';
    return <Marker name={own} />;
  };
  return <><Marker name={glyph} /><Marker name={s} /></>;
}
  export const B = () => {
    const { own } = z;
    return <Marker name={glyph} variant='sharp' />;
  };
""",
    }
    # The inner parameter hides the constant of its name, so that site takes every name of the file.
    every = {("rounded", n, "f") for n in ("tent", "castle", "flag", "bus", "ferry")}
    plain = {("rounded", "flag", "d"), ("rounded", "bus", "d"), ("rounded", "ferry", "d"), ("rounded", "castle", "d"), ("sharp", "tent", "d")}
    return files, every | plain, {("s/a.tsx", 6): "'s' could not be found"}


def tables_and_templates():
    sizes, kinds = [f"s{i}" for i in range(20)], [f"k{i}" for i in range(15)]
    files = {
        "t/t.tsx": IMPORT
        + f"""const DEEP = {{ one: {{ two: {{ three: {{ four: 'peak', five: ['beach', {{ six: 'lake' }}] }} }} }} }};
const SIZES = [{', '.join(map(repr, sizes))}];
const KINDS = [{', '.join(map(repr, kinds))}];
const part = late ? 'tower' : 'bridge';
export const A = ({{ i, j }}) => <>
  <Marker name={{DEEP.one.two.three.four}} />
  <Marker name={{DEEP['one'].two['three'].five[1].six}} />
  <Marker name={{`${{part}}_${{late ? 'a' : 'b'}}`}} filled />
  <Marker name={{`x_${{`${{part}}`}}`}} filled />
</>;
""",
        "t/many.tsx": IMPORT + f"const SIZES = [{', '.join(map(repr, sizes))}];\nconst KINDS = [{', '.join(map(repr, kinds))}, 'tent'];\nexport const M = ({{ i }}) => <Marker name={{`${{SIZES[i]}}_${{KINDS[i]}}`}} variant='dim' />;\n",
    }
    said = {("rounded", n, "d") for n in ("peak", "lake")} | {("rounded", n, "f") for n in COMPOSED if n[-1] != "c"}
    # 320 combinations are too many: the names of the file instead, and a word about it.
    return files, said | {("dim", "tent", "d")}, {("t/many.tsx", 4): "too many values"}


COMPOSED = [*(f"{p}_{x}" for p in ("tower", "bridge") for x in "abc"), "x_tower", "x_bridge"]


def test_wrappers_scopes_tables_and_templates(spark):
    """In one analysis, for none imports from another: parameters that are passed on, stepped into and put into texts; nested and shadowed constants; tables
    of any depth; templates as products."""
    made = [passed_on(), shadowed(), tables_and_templates()]
    uses, messages = analyzed(spark, {k: v for files, _, _ in made for k, v in files.items()}, [*NAMES, *COMPOSED])
    assert uses == set().union(*(u for _, u, _ in made))
    wanted = {k: v for _, _, m in made for k, v in m.items()}
    assert set(messages) == set(wanted) and all(wanted[k] in m for k, m in messages.items())
