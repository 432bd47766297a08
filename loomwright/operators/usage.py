"""Which names a component is rendered with, traced through constants, imports and wrapper components.

Facts are taken out of the code by regular expressions, with their places, and everything after that is joins: identifiers with the innermost scope that
declares them (scopes.innermost), imports with files, tags with the components they are bound to. Each attribute is traced once where it stands,
down to values and parameters; what wrappers pass on is then composed over their calls (summaries.compose), so that chains of calls are never listed. Tracing is a
work list: rows (key, place, expression, member accesses) are split into branches, branches that are values are done, and
those that name something are joined with what it stands for, until nothing new is left. What cannot be traced is
never dropped: the site takes the dictionary names of its file and of the files it imports, and a diagnostic says so.

A top-level statement begins in a line of its own, at no depth of brackets. Expressions are read to DEEP levels of brackets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values
from ..sources import tables
from ..sources.file_tree import with_code
from . import scopes, summaries
from .graph import reach, resolve_imports, written
from .summaries import atom

#: Levels of brackets in one expression.
DEEP = 10
#: Characters of member accesses; circles of tables end there, with a diagnostic.
LONGEST_STEPS = 120

_STRING = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*+'|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*+\""


def _nested(opening: str, closing: str, deep: int = DEEP) -> str:
    """Balanced brackets, of any kind within, to deep levels. Loops are possessive, so that long texts need no stack."""
    inside = rf"(?:[^(){{}}\[\]'\"`]++|{_STRING}|`[^`]*+`|['\"`])*+"
    for _ in range(deep - 1):
        inside = rf"(?:[^(){{}}\[\]'\"`]++|{_STRING}|`[^`]*+`|[({{\[]{inside}[)}}\]]|['\"`])*+"
    return opening + inside + closing


_BRACES, _BRACKETS, _PARENS = _nested(r"\{", r"\}"), _nested(r"\[", r"\]"), _nested(r"\(", r"\)")
_SIMPLE = r"`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{[^{}`]*+\})*+`"
_INSIDE = rf"(?:[^{{}}`]++|{_SIMPLE}|\{{(?:[^{{}}`]++|{_SIMPLE})*+\}})*+"
_TEMPLATE = rf"`(?:[^`\\$]++|\\.|\$(?!\{{)|\$\{{{_INSIDE}\}})*+`"
_TAG = r"<([A-Z][\w$]*(?:\.[A-Z][\w$]*)?)((?:\s(?:[^<>{}]++|" + _BRACES + r")*+)?)/?>"
_CREATE = r"\b(?:createElement|jsxs?|_jsxs?)\(\s*([A-Z][\w$.]*)\s*(?:,\s*(" + _BRACES + r"))?"
_ATTRIBUTE = r"([A-Za-z_$][\w$-]*)(?:\s*=\s*(" + _STRING + "|" + _BRACES + r"))?|\{\s*\.\.\.\s*([\w$.]+)\s*\}"
_PAIR = r"(?:([A-Za-z_$][\w$]*)|'([^'\n]*)'|\"([^\"\n]*)\")\s*:\s*((?:" + _STRING + "|" + _PARENS + "|" + _BRACKETS + "|" + _BRACES + r"|[^,{}\[\]()'\"]++)++)"
#: The value is looked at and not taken, for it may be a function with declarations of its own.
_CONST = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)(?:\s*:[^=;\n]+)?\s*=(?![=>])\s*+(?=((?:" + _STRING + "|`[^`]*`|" + _PARENS + "|" + _BRACKETS + "|" + _BRACES + r"|[^;{}\[\]()'\"`\n]++)++))"
_STATEMENT = r"(?m)^(?=[ \t]*(?:export|import|const|let|var|function|async|class|type|interface|enum|declare)\b)"
_LAMBDA = r"(?:\bfunction\s*[\w$]*\s*)?(" + _nested(r"\(", r"\)", 3) + r")\s*(?::[^=(){};]*)?(?:=>|\{)|\b([A-Za-z_$][\w$]*)\s*=>"
_COMPONENT = r"\A(?:export\s+(default\s+)?)?(?:async\s+)?(?:function\s+([A-Z][\w$]*)\s*(?:<[^>]*>)?|(?:const|let|var)\s+([A-Z][\w$]*)(?:\s*:[^=\n]+)?\s*=\s*(?:[\w$.]*(?:memo|forwardRef)\s*(?:<[^>]*>)?\(\s*)*(?:async\s*)?(?:function\s*[\w$]*\s*)?)\(\s*(?:(" + _BRACES + r")|([A-Za-z_$][\w$]*))?"


@dataclass
class Usage:
    uses: DataFrame  # variant, name, shape
    diagnostics: DataFrame  # path, line, message
    fallback_files: DataFrame  # path
    sites: int
    wrappers: DataFrame  # path, component


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _zip(text: Column, pattern: str, **groups: int) -> Column:
    return F.arrays_zip(*[_all(text, pattern, g).alias(n) for n, g in groups.items()])


def statements(files: DataFrame) -> DataFrame:
    """(path, seq, line, text): top-level statements, without line comments.

    Code is cut before the words that begin statements, and cuts inside brackets are undone: a running sum of each piece's brackets tells how deep the next
    one begins. A cut in column 0 always counts, so that a bracket that is never closed spoils one statement only.
    """
    pieces = F.split(T.without_line_comments(F.col("code")), _STATEMENT)
    bare = lambda t: F.regexp_replace(t, rf"/\*(?s:.*?)\*/|{values.STRING}|{values.TEMPLATE}", "")
    turns = lambda t: F.regexp_count(bare(t), F.lit(r"[({\[]")) - F.regexp_count(bare(t), F.lit(r"[)}\]]"))

    def join(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        inside = (F.size(done) > 0) & (F.coalesce(last["depth"], F.lit(0)) > 0) & piece.rlike(r"\A[ \t]")
        whole = F.struct(F.concat(last["text"], piece).alias("text"), (last["depth"] + turns(piece)).alias("depth"))
        return F.when(inside, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(F.struct(piece.alias("text"), turns(piece).alias("depth")))))

    joined = F.aggregate(pieces, F.array().cast("array<struct<text:string,depth:int>>"), join, lambda done: F.transform(done, lambda x: x["text"]))
    split = files.select("path", joined.alias("parts"))
    # Lines before each statement, as a running sum of the statements' own line ends.
    counts = F.transform("parts", lambda t: F.regexp_count(t, F.lit("\n")))
    running = F.aggregate(counts, F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    parts = split.select("path", F.posexplode(F.arrays_zip("parts", F.slice(running, F.lit(1), F.size("parts")).alias("line"))).alias("seq", "p"))
    return parts.select("path", "seq", F.col("p.line").alias("line"), F.regexp_replace("p.parts", r"\A[ \t]+", "").alias("text")).where("trim(text) <> ''")


def cached_statements(spark: SparkSession, files: DataFrame, path: str, *, read=None) -> DataFrame:
    """statements() of listed files (path, mtime_ms, size), of which only those are read that the table at path does not have with equal time and size.

    The table then holds the statements of these files and no others; it stays as it is where nothing changed. All facts are derived
    from statements, so no other file is read again. read gives files their code (by default from a mount).
    """
    on = ["path", "mtime_ms", "size"]
    known = tables.read_table(spark, path, "path string, mtime_ms double, size bigint, seq int, line int, text string")
    files = written(files.select(*on), "listing")
    kept = known.join(files, on, "left_semi")
    fresh = written(files.join(known.select(*on).distinct(), on, "left_anti"), "fresh")
    gone = known.select(*on).distinct().join(files, on, "left_anti")
    if fresh.isEmpty() and gone.isEmpty():
        return known.select("path", "seq", "line", "text")
    code = (read or with_code)(fresh)
    new = statements(code).join(fresh, "path").select(*on, "seq", F.col("line").cast("int").alias("line"), "text")
    empty = fresh.join(new.select("path").distinct(), "path", "left_anti").select(*on, F.lit(-1).alias("seq"), F.lit(0).alias("line"), F.lit("").alias("text"))
    tables.write_table(kept.unionByName(new).unionByName(empty), path)
    return tables.read_table(spark, path, known.schema).select("path", "seq", "line", "text")


def imports(stmts: DataFrame) -> DataFrame:
    """(path, local, imported, source); 'default' and '*' as they are called."""
    from_ = stmts.where(F.col("text").rlike(r"\Aimport\b(?!\s+type\b)")).select("path", F.regexp_extract("text", r"\Aimport\s+([^'\"]*?)\s*from", 1).alias("what"), F.regexp_extract("text", r"['\"]([^'\"]+)['\"]", 1).alias("source"))
    default = from_.where(F.col("what").rlike(r"\A[A-Za-z_$]")).select("path", F.regexp_extract("what", r"\A([\w$]+)", 1).alias("local"), F.lit("default").alias("imported"), "source")
    star = from_.where(F.col("what").contains("*")).select("path", F.regexp_extract("what", r"\*\s*as\s+([\w$]+)", 1).alias("local"), F.lit("*").alias("imported"), "source")
    each = from_.select("path", "source", F.explode(F.split(F.regexp_extract("what", r"\{([^}]*)\}", 1), ",")).alias("one"))
    one = F.trim(F.regexp_replace("one", r"\A\s*type\s+", ""))
    named = each.where(F.trim("one") != "").select("path", F.regexp_extract(one, r"([\w$]+)\s*\z", 1).alias("local"), F.regexp_extract(one, r"\A([\w$]+)", 1).alias("imported"), "source")
    return default.unionByName(star).unionByName(named)


def reexports(stmts: DataFrame) -> DataFrame:
    """(path, exported, imported, source); export * is '*' of '*'."""
    from_ = stmts.where(F.col("text").rlike(r"\Aexport\s*(?:\*|\{[^}]*\})\s*from")).select("path", "text", F.regexp_extract("text", r"['\"]([^'\"]+)['\"]", 1).alias("source"))
    star = from_.where(F.col("text").rlike(r"\Aexport\s*\*\s*from")).select("path", F.lit("*").alias("exported"), F.lit("*").alias("imported"), "source")
    each = from_.select("path", "source", F.explode(F.split(F.regexp_extract("text", r"\{([^}]*)\}", 1), ",")).alias("one")).where(F.trim("one") != "")
    one = F.trim("one")
    return star.unionByName(each.select("path", F.regexp_extract(one, r"([\w$]+)\s*\z", 1).alias("exported"), F.regexp_extract(one, r"\A([\w$]+)", 1).alias("imported"), "source"))


def components(stmts: DataFrame) -> DataFrame:
    """(path, seq, component, export, params, whole): functions that may be components. export is null unless exported; params are {local, prop, default}."""
    c = stmts.where(F.col("text").rlike(_COMPONENT))
    name = F.concat(F.regexp_extract("text", _COMPONENT, 2), F.regexp_extract("text", _COMPONENT, 3))
    exported = F.when(F.regexp_extract("text", _COMPONENT, 1) != "", "default").when(F.col("text").startswith("export"), name)
    inner = F.regexp_replace(F.regexp_extract("text", _COMPONENT, 4), r"\A\{|\}\z", "")
    one = r"\A\s*([\w$]+)\s*(?::\s*([\w$]+))?\s*(?:=\s*(.*?))?\s*\z"
    each = F.filter(F.split(inner, r",(?![^({\[]*[)}\]])"), lambda p: F.trim(p) != "")
    params = F.transform(each, lambda p: F.struct(
        F.when(F.regexp_extract(p, one, 2) != "", F.regexp_extract(p, one, 2)).otherwise(F.regexp_extract(p, one, 1)).alias("local"),
        F.regexp_extract(p, one, 1).alias("prop"), F.regexp_extract(p, one, 3).alias("dflt")))
    rest = F.regexp_extract(inner, r"\.\.\.\s*([\w$]+)\s*\z", 1)
    whole = F.regexp_extract("text", _COMPONENT, 5)
    return c.select("path", "seq", name.alias("component"), exported.alias("export"), F.filter(params, lambda p: p["local"] != "").alias("params"), F.when(whole != "", whole).otherwise(rest).alias("whole"))


def sites(stmts: DataFrame) -> DataFrame:
    """(site, path, seq, line, at, tag, attrs, spread): tags and createElement calls of capitalised names, with their attributes as text."""
    tags = stmts.select("path", "seq", "line", "text", F.posexplode(scopes.offsets(F.col("text"), _TAG, 1, 2)).alias("no", "t"))
    jsx = tags.select("path", "seq", F.lit("jsx").alias("kind"), "no", F.col("t.at").alias("at"), _line().alias("line"), F.col("t.g0").alias("tag"), F.transform(_zip(F.col("t.g1"), _ATTRIBUTE, name=1, value=2, spread=3), lambda x: F.struct(x["name"].alias("name"), F.when(x["value"].startswith("{"), x["value"]).otherwise(T.without_references(x["value"])).alias("value"), x["spread"].alias("spread"))).alias("a"))
    calls = stmts.select("path", "seq", "line", "text", F.posexplode(scopes.offsets(F.col("text"), _CREATE, 1, 2)).alias("no", "t"))
    made = calls.select("path", "seq", F.lit("call").alias("kind"), "no", F.col("t.at").alias("at"), _line().alias("line"), F.col("t.g0").alias("tag"), F.transform(_zip(F.col("t.g1"), _PAIR, n=1, v=4), lambda p: F.struct(p["n"].alias("name"), p["v"].alias("value"), F.lit("").alias("spread"))).alias("a"))
    every = jsx.unionByName(made)
    attrs = F.transform(F.filter("a", lambda x: x["name"] != ""), lambda x: F.struct(x["name"].alias("name"), F.when(x["value"] == "", "true").otherwise(F.regexp_replace(x["value"], r"\A\{(?s:(.*))\}\z", "$1")).alias("value")))
    return every.select(F.concat_ws("|", "path", "seq", "kind", "no").alias("site"), "path", "seq", "line", "at", "tag", attrs.alias("attrs"), F.get(F.filter(F.transform("a", lambda x: x["spread"]), lambda s: s != ""), F.lit(0)).alias("spread"))


def _line() -> Column:
    """The line of what begins at t.at of a statement."""
    return F.col("line") + F.regexp_count(F.left("text", F.col("t.at")), F.lit("\n"))


def escapes(stmts: DataFrame, bound: DataFrame) -> DataFrame:
    """(path, seq, line, local) where a bound component stands as a value: passed on, stored or called. Tags, element calls, declarations, new names for it,
    exports and imports are no such places, and what stands in strings isn't either."""
    text = F.regexp_replace(F.regexp_replace("text", T.STRINGS, "''"), r"\b(?:createElement|jsxs?|_jsxs?|memo|forwardRef)\(\s*[\w$.]+", "")
    text = F.regexp_replace(text, r"(?<=[\w$]\s{0,4})=\s*[A-Z][\w$.]*\s*(?=[;\n]|\z)", "")
    code = stmts.where(~F.col("text").rlike(r"\A(?:import\b|export\s*(?:\{|\*|default\s+[\w$]+\s*;?\s*\z))")).select("path", "seq", F.col("line").alias("from"), text.alias("text"))
    there = code.join(bound.select("path", "local").distinct(), "path").where(F.contains("text", F.col("local")))
    pattern = F.concat(F.lit(r"(?s)\A(.*?)(?<![\w$.<'\"/])(?<!\b(?:function|const|let|var|class)\s{1,3})\Q"), F.col("local"), F.lit(r"\E(?![\w$'\":.])"))
    before = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))
    return there.where(F.rlike("text", pattern)).select("path", "seq", (F.col("from") + F.regexp_count(before, F.lit("\n"))).alias("line"), "local")


def constants(stmts: DataFrame) -> DataFrame:
    """(path, seq, at, top, name, expr): const, let and var with a value; top says that the statement itself is the declaration."""
    each = stmts.select("path", "seq", "text", F.explode(scopes.offsets(F.col("text"), _CONST, 1, 2)).alias("c"))
    top = (F.regexp_extract("text", r"\A(?:export\s+)?(?:const|let|var)\s+([\w$]+)", 1) == F.col("c.g0")) & (F.col("c.at") <= 16)
    return each.select("path", "seq", F.col("c.at").alias("at"), top.alias("top"), F.col("c.g0").alias("name"), F.trim("c.g1").alias("expr")).distinct()


def declarations(stmts: DataFrame, consts: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, seq, id, start, end, prior, kind, decl_at, value, dflt): what names stand for inside a statement, with the interval where they do.

    kind const has its expression as value, param the property it is taken from, whole stands for all properties, and lambda for a parameter of an
    inner function, of which nothing is known. Constants and inner parameters are seen within the innermost brackets around their declaration."""
    spans = scopes.intervals(stmts, "path", "seq")
    lambdas = stmts.select("path", "seq", F.posexplode(scopes.offsets(F.col("text"), _LAMBDA, 1, 2)).alias("no", "m"))
    # The first parameter list of a component is its own.
    lambdas = lambdas.join(owners.select("path", "seq", F.lit(0).alias("no")).distinct(), ["path", "seq", "no"], "left_anti")
    words = F.when(F.col("m.g1") != "", F.array("m.g1")).otherwise(F.transform(F.split(F.regexp_replace("m.g0", r"=[^,]*|(?<=[\w$])\s*\??\s*:\s*(?![\w$]+\s*[,}])[^,)]*", ""), r"[,{}\[\]()]"), lambda p: F.regexp_extract(p, r"([A-Za-z_$][\w$]*)\s*\z", 1)))
    inner = lambdas.select("path", "seq", F.col("m.at").alias("at"), F.explode(words).alias("id")).where("id <> ''").select("*", F.lit("lambda").alias("kind"), F.lit("").alias("value"))
    inner = inner.unionByName(consts.where("NOT top").select("path", "seq", "at", F.col("name").alias("id"), F.lit("const").alias("kind"), F.col("expr").alias("value")))
    placed = scopes.innermost(inner, spans, ["path", "seq"])
    # A declaration in no brackets is seen in the whole statement.
    free = inner.join(placed.select("path", "seq", "at", "id", "kind"), ["path", "seq", "at", "id", "kind"], "left_anti").withColumns({"start": F.lit(-1), "end": F.lit(scopes.END)})
    columns = ["path", "seq", "id", "start", "end", "kind", F.col("at").alias("decl_at"), "value", F.lit("").alias("dflt")]
    found = placed.select(*columns).unionByName(free.select(*columns))
    outer = lambda df: df.withColumns({"start": F.lit(-1), "end": F.lit(scopes.END), "decl_at": F.lit(0)})
    params = outer(owners.select("path", "seq", F.explode("params").alias("p")).select("path", "seq", F.col("p.local").alias("id"), F.lit("param").alias("kind"), F.col("p.prop").alias("value"), F.col("p.dflt").alias("dflt")))
    wholes = outer(owners.where("whole <> ''").select("path", "seq", F.col("whole").alias("id"), F.lit("whole").alias("kind"), F.lit("").alias("value"), F.lit("").alias("dflt")))
    prior = F.when(F.col("kind") == "const", 0).when(F.col("kind") == "lambda", 2).otherwise(1)
    return found.unionByName(params).unionByName(wholes).withColumn("prior", prior)


def _peeled(e: Column) -> Column:
    """An expression without what doesn't change its value: type assertions, a non-null mark, outer parentheses, a template of one expression."""
    e = F.trim(e)
    for _ in range(2):
        e = F.regexp_replace(e, r"\s+(?:as|satisfies)\s+(?:const|[\w$.<> |'\"]+(?:\[\])*)(?=\s*(?:\z|[)?:|&,]))", "")
        e = F.trim(F.regexp_replace(e, r"\A\((?s:((?:[^()]|\((?:[^()]|\([^()]*\))*\))*))\)\z", "$1"))
        e = F.regexp_replace(e, r"\A`\$\{([^{}`]*(?:\{[^{}]*\}[^{}`]*)*)\}`\z", "$1")
        e = F.trim(F.regexp_replace(e, r"(?<=[\w$\])])!\z", ""))
    return e


def branches(e: Column) -> Column:
    """The values an expression may have, as expressions: both sides of a conditional, both operands of a logical operator."""
    mark = "\x01"
    s = F.regexp_replace(_peeled(e), r"\?\?|\|\||&&", mark)
    s = F.regexp_replace(s, rf"(?:\A|(?<=[:{mark}]))[^:?{mark}'\"`{{}}\[\]]*?(?:[=!<>]==?[^:?{mark}]*?|\[[^\]]*\][^:?{mark}]*?)?\?(?![.?])", mark)
    simple = F.split(F.regexp_replace(s, rf":(?=[^{{}}\[\]]*\z)", mark), mark)
    whole = _peeled(e).rlike(r"\A(?:" + _BRACES + "|" + _BRACKETS + "|" + _STRING + "|" + _TEMPLATE + r")\z")
    return F.when(whole, F.array(_peeled(e))).otherwise(F.filter(F.transform(simple, _peeled), lambda x: x != ""))


def _bindings(named: DataFrame, via: DataFrame, exported: DataFrame) -> DataFrame:
    """(path, local, target) of resolved imports (named) of exported components (path, export, target), through resolved re-exports (via)."""
    out = front = written(exported.select("path", "export", "target").distinct(), "exported")
    while not front.isEmpty():
        more = via.join(front.select(F.col("path").alias("resolved"), "export", "target"), "resolved").where((F.col("imported") == F.col("export")) | (F.col("imported") == "*"))
        more = more.select("path", F.when(F.col("exported") == "*", F.col("export")).otherwise(F.col("exported")).alias("export"), "target").distinct()
        front = written(more.join(out, ["path", "export", "target"], "left_anti"), "exported")
        out = out.unionByName(front)
    used = named.join(out.select(F.col("path").alias("resolved"), F.col("export").alias("imported"), "target"), ["resolved", "imported"])
    return used.select("path", "local", "target").distinct()


def analyze(files: DataFrame, names: DataFrame, *, library: str, component: str, default_variant: str = "rounded", stmts: DataFrame | None = None) -> Usage:
    """Trace `component` of `library` over files (path, code).

    names (name) is the dictionary; other names are dropped silently. Attributes are name, variant and filled: a site without name says nothing, without variant
    it is of default_variant, without filled of shape d. A variant that cannot be traced is '*', a filled that cannot is both shapes. A wrapper is a component
    that renders the component, or another wrapper, with something of its own parameters; its sites are read once for each call of it. stmts are the statements
    of files, where they are known already (cached_statements); names of files that are included as a whole are read from code in any case.
    """
    stmts = written(statements(files) if stmts is None else stmts.where("seq >= 0"), "statements")
    imps, reexp, comps, consts = (written(f(stmts), f.__name__) for f in (imports, reexports, components, constants))
    raw = written(sites(stmts), "sites")
    owners = comps.select("path", "seq", "component", "export", "params", "whole")
    lib = F.lit("lib")
    exported = reexp.where(F.col("source") == library).where(F.col("imported").isin(component, "*")).select("path", F.when(F.col("exported") == "*", component).otherwise(F.col("exported")).alias("export"), lib.alias("target"))
    direct = imps.where((F.col("source") == library) & (F.col("imported") == component)).select("path", "local", lib.alias("target"))
    spaces = imps.where((F.col("source") == library) & (F.col("imported") == "*")).select("path", F.concat("local", F.lit("." + component)).alias("local"), lib.alias("target"))
    known = direct.unionByName(spaces)
    wrappers, count, shown = None, -1, None
    named = written(resolve_imports(imps.where("imported <> '*'"), files), "resolved")
    via = written(resolve_imports(reexp, files), "resolved")
    while True:
        # Imports are bound anew only where something new is exported.
        if shown != (shown := exported.distinct().count()):
            imported = written(_bindings(named, via, exported), "imported")
        bound = known.unionByName(imported)
        if wrappers is not None:
            bound = bound.unionByName(wrappers.select("path", F.col("component").alias("local"), "target"))
        again = consts.where("top").join(bound.withColumnRenamed("local", "expr"), ["path", "expr"]).select("path", F.col("name").alias("local"), "target")
        bound = written(bound.unionByName(again).distinct(), "bound")
        hit = raw.join(bound.withColumnRenamed("local", "tag"), ["path", "tag"]).join(owners, ["path", "seq"], "left")
        begins = lambda b, name, after: F.rlike(b, F.concat(F.lit(r"\A\Q"), name, F.lit(rf"\E{after}")))
        in_template = lambda b, name: b.startswith("`") & F.rlike(b, F.concat(F.lit(r"\$\{\s*\Q"), name, F.lit(r"\E\s*[}.?!]")))
        from_param = lambda b: F.exists("params", lambda p: begins(b, p["local"], r"(?![\w$(])") | in_template(b, p["local"])) | ((F.col("whole") != "") & begins(b, F.col("whole"), r"\."))
        reads = F.exists("attrs", lambda a: F.exists(branches(a["value"]), from_param))
        spreads = (F.col("spread") == F.col("whole")) & (F.col("whole") != "")
        made = hit.where(F.col("component").isNotNull() & (reads | F.coalesce(spreads, F.lit(False)))).select("path", "seq", "component", "export", F.concat_ws("#", "path", "component").alias("target"), "params", "whole").distinct()
        # `export default Name` and `export { Name }` name a component after the fact.
        later = stmts.select("path", F.regexp_extract("text", r"\Aexport\s+default\s+(?:[\w$.]*(?:memo|forwardRef)\()?([A-Z][\w$]*)\)?\s*;?\s*\z", 1).alias("component")).where("component <> ''").select("path", "component", F.lit("default").alias("late"))
        wrappers = written(made.join(later, ["path", "component"], "left").withColumn("export", F.coalesce("export", "late")).drop("late"), "wrappers")
        exported = exported.select("path", "export", "target").unionByName(wrappers.where("export IS NOT NULL").select("path", "export", "target")).distinct()
        now = wrappers.count()
        if now == count:
            break
        count = now
    all_sites = written(hit.drop("component", "export").join(wrappers.select("path", "seq", "component", F.col("target").alias("inside")), ["path", "seq"], "left"), "bound-sites")

    lib_sites = all_sites.where("target = 'lib'")
    longest = max(64, names.agg(F.max(F.length("name"))).first()[0] or 0)
    spans = written(declarations(stmts, consts, owners), "declarations")
    traced = _Tracer(named, via, stmts, consts, imps, spans, longest)
    rows = summaries.compose(*_summaries(all_sites, stmts, wrappers, traced), longest=longest)
    open_ = F.transform("atoms", lambda a: F.when(a["kind"].isin("prop", "part"), F.struct(a["attr"].alias("attr"), F.lit("unknown").alias("kind"), F.concat(F.lit("'"), F.regexp_extract(a["value"], r"([\w$]+)", 1), F.lit("' is a parameter")).alias("value"))).otherwise(F.struct(a["attr"].alias("attr"), a["kind"].alias("kind"), a["value"].alias("value"))))
    ends = rows.where("owner IS NULL").select(F.col("origin").alias("site"), F.concat_ws("@", "origin", F.sha2(F.to_json("atoms"), 256)).alias("instance"), open_.alias("atoms"))
    done = ends.select("instance", F.explode("atoms").alias("a")).select("instance", "a.*")
    instances = ends.select("instance", "site").join(lib_sites.select("site", "path", "line"), "site")
    # A component that stands as a value has attributes that nobody sees: a use without a known name.
    values_ = escapes(stmts, bound).select(F.concat_ws("|", F.lit("value"), "path", "seq", "local").alias("site"), "path", "seq", "line", F.concat("local", F.lit(" is used as a value, so its attributes cannot be traced")).alias("why"))
    values_ = written(values_.withColumn("instance", F.col("site")), "values")
    kinds = F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(k).alias("kind")) for a, k in (("name", "unknown"), ("variant", "undef"), ("filled", "undef"))])
    lost = values_.select("instance", "why", F.explode(kinds).alias("k")).select("instance", "k.attr", "k.kind", F.when(F.col("k.attr") == "name", F.col("why")).alias("value"))
    instances = written(instances.select("instance", "site", "path", "line").unionByName(values_.select("instance", "site", "path", "line")), "instances")
    done = written(done.unionByName(lost).distinct(), "traced")
    callers = all_sites.where("target <> 'lib'").select(F.coalesce("inside", F.lit("")).alias("src"), F.col("target").alias("dst")).distinct()
    called = reach(callers, files.sparkSession.createDataFrame([("",)], "node string"))
    # Sites of components that nobody calls are sites all the same.
    n_sites = instances.select("site").distinct().count()
    return _collected(done, instances, names, files, imps, wrappers, called, n_sites, default_variant)


def _summaries(all_sites: DataFrame, stmts: DataFrame, wrappers: DataFrame, traced: _Tracer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, calls and answers for summaries.compose()."""
    spark = all_sites.sparkSession
    calls = all_sites.where("target <> 'lib'").select(F.col("site").alias("call"), F.col("inside").alias("owner"), "target")
    own = written(wrappers.select(F.col("target").alias("fn"), "path", "seq", "params", "whole").dropDuplicates(["fn"]), "functions")
    # What is asked of a target: attributes of the component, parameters of a wrapper, and of one that passes all on, what is asked of whom it passes it to.
    lib = spark.createDataFrame([("lib", a) for a in ("name", "variant", "filled")], "fn string, prop string")
    named = own.select("fn", F.explode("params").alias("p")).select("fn", F.col("p.prop").alias("prop"))
    member = F.call_function("regexp_extract_all", F.col("text"), F.concat(F.lit(r"(?<![\w$.])\Q"), "whole", F.lit(r"\E\??\.([\w$]+)")), F.lit(1))
    read = own.where("whole <> ''").join(stmts.select("path", "seq", "text"), ["path", "seq"]).select("fn", F.explode(member).alias("prop"))
    passes = all_sites.where("inside IS NOT NULL AND whole <> '' AND spread = whole").select(F.col("inside").alias("by"), F.col("target").alias("fn")).distinct()
    asked = front = written(lib.unionByName(named).unionByName(read).distinct(), "asked")
    while True:
        more = front.join(passes, "fn").select(F.col("by").alias("fn"), "prop").distinct()
        front = written(more.join(asked, ["fn", "prop"], "left_anti"), "asked")
        if front.isEmpty():
            break
        asked = asked.unionByName(front)
    known = None
    want = all_sites.join(asked.withColumnRenamed("fn", "target"), "target").select("site", "prop", F.lit("").alias("steps"))
    dflts = own.select("fn", F.col("path").alias("d_path"), F.col("seq").alias("d_seq"), F.explode("params").alias("p")).select("fn", "d_path", "d_seq", F.col("p.prop").alias("prop"), F.col("p.dflt").alias("dflt"))
    while True:
        # What a site gives for a property: its attribute, what it passes on as a whole, the wrapper's default, or nothing.
        row = want.join(all_sites.select("site", "path", "seq", "at", "attrs", "spread", F.col("target").alias("fn")), "site").join(dflts, ["fn", "prop"], "left")
        given = F.get(F.filter("attrs", lambda a: a["name"] == F.col("prop")), F.lit(0))["value"]
        given = F.coalesce(given, F.when(F.col("spread").isNotNull(), F.concat("spread", F.lit("."), "prop")))
        dflt = F.when(given.isNull() & (F.col("dflt") != ""), F.col("dflt"))
        place = lambda c, d, o: F.when(dflt.isNotNull(), d).otherwise(o).alias(c)
        keyed = row.select("site", "prop", "steps", F.coalesce(given, dflt, F.lit("undefined")).alias("expr"), place("path", F.col("d_path"), F.col("path")), place("seq", F.col("d_seq"), F.col("seq")), place("at", F.lit(1), F.col("at")), dflt.isNotNull().alias("by_default"))
        keyed = written(keyed.withColumn("key", F.sha2(F.concat_ws("\x1e", "site", "prop", "steps"), 256)), "keyed")
        atoms = traced.atoms(keyed.select("key", "path", "seq", "at", "expr", "steps"))
        said = keyed.select("key", F.col("site").alias("call"), "prop", "steps", "by_default").join(atoms, "key")
        # A default that reads another parameter would be read at the wrong place.
        strange = F.transform("said", lambda a: F.when(F.col("by_default") & a["kind"].isin("prop", "part"), atom("unknown", F.lit("a default that depends on a parameter"))).otherwise(a))
        new = written(said.select("call", "prop", "steps", strange.alias("said")), "answers")
        known = new if known is None else known.unionByName(new)
        # Parameters that are stepped into, or found on the way only, are asked for at the calls of the wrapper where they were found.
        refs = F.flatten(F.transform("said", lambda a: F.when(a["kind"] == "prop", F.array(summaries.hole(a["value"], a["steps"]))).when(a["kind"] == "part", summaries.holes_of(a["value"])).otherwise(F.array().cast("array<string>"))))
        found = new.join(all_sites.where("inside IS NOT NULL").select(F.col("site").alias("call"), "inside"), "call").select("inside", F.explode(refs).alias("ref")).distinct()
        parts = F.split(F.regexp_replace("ref", "[\x02\x03]", ""), "\x1f")
        found = found.join(calls.select(F.col("call").alias("site"), F.col("target").alias("inside")), "inside").select("site", parts[0].alias("prop"), parts[1].alias("steps")).distinct()
        want = written(found.join(known.select(F.col("call").alias("site"), "prop", "steps"), ["site", "prop", "steps"], "left_anti"), "want")
        if want.isEmpty():
            break
    known = written(known, "answers")
    attr = lambda a: F.transform("said", lambda x: F.struct(F.lit(a).alias("attr"), x["kind"].alias("kind"), x["value"].alias("value"), x["steps"].alias("steps")))
    each = [known.where(F.col("prop") == a).select(F.col("call").alias("site"), F.explode(attr(a)).alias("a")) for a in ("name", "variant", "filled")]
    uses = reduce(DataFrame.unionByName, each).join(all_sites.where("target = 'lib'").select("site", "inside"), "site")
    rows = uses.groupBy(F.col("inside").alias("owner"), F.col("site").alias("origin")).agg(F.collect_set("a").alias("atoms"))
    return rows, calls, known


class _Tracer:
    """Expressions to atoms, where they stand."""

    def __init__(self, named, via, stmts, consts, imps, spans, longest: int):
        self.spans, self.longest = spans, longest
        resolved = named.where("imported <> 'default'").select("path", "local", "imported", "resolved")
        exported = consts.where("top").select(F.col("path").alias("resolved"), F.col("name").alias("imported"), F.col("seq").alias("to_seq"), F.col("expr").alias("to_expr"))
        self.tops = consts.where("top").select("path", F.col("name").alias("id"), F.col("seq").alias("to_seq"), F.col("expr").alias("to_expr"))
        remote = resolved.join(exported, ["resolved", "imported"]).select("path", F.col("local").alias("id"), F.col("resolved").alias("to_path"), "to_seq", "to_expr")
        passed = resolved.join(via.select(F.col("path").alias("resolved"), F.col("exported"), F.col("imported").alias("inner"), F.col("resolved").alias("far")), "resolved").where("exported = imported OR exported = '*'")
        passed = passed.select("path", F.col("local").alias("id"), F.col("far").alias("resolved"), F.when(F.col("exported") == "*", F.col("imported")).otherwise(F.col("inner")).alias("imported")).join(exported, ["resolved", "imported"])
        # A named import of which no file is known: whatever file exports a constant of that name.
        shown = stmts.where(F.col("text").startswith("export")).select(F.col("path").alias("resolved"), F.col("seq").alias("to_seq"))
        homeless = imps.where("imported NOT IN ('*', 'default')").join(resolved.select("path", "local").distinct(), ["path", "local"], "left_anti")
        guessed = homeless.join(exported.join(shown, ["resolved", "to_seq"]), "imported").select("path", F.col("local").alias("id"), F.col("resolved").alias("to_path"), "to_seq", "to_expr")
        self.remote = written(remote.unionByName(guessed).unionByName(passed.select("path", "id", F.col("resolved").alias("to_path"), "to_seq", "to_expr")).distinct(), "remote")

    def atoms(self, work: DataFrame) -> DataFrame:
        """(key, said) of work (key, path, seq, at, expr, steps)."""
        place = ["path", "seq", "at"]
        columns = ["key", *place, "expr", "steps"]
        work = written(_branched(work).select(*columns), "work")
        seen, done, templates = work, None, None
        ident = r"\A([A-Za-z_$][\w$]*)((?:\??\.[\w$]+|\??\.?\[(?:[^\[\]]|\[[^\[\]]*\])*\])*)\z"
        while True:
            e, steps = F.col("expr"), F.col("steps")
            quoted = e.rlike(r"\A(?:" + _STRING + r"|`[^`$]*`)\z")
            table = e.rlike(r"\A(?:\{(?s:.*)\}|\[(?s:.*)\])\z")
            constant = quoted | e.isin("true", "false", "undefined", "null", "void 0") | e.rlike(r"\A\d+\z")
            kind = (
                F.when(F.length("steps") > LONGEST_STEPS, "deep").when(table & (steps != ""), "table").when(constant, F.when(steps == "", "value").otherwise("undef"))
                .when(e.rlike(ident), "name").when(e.rlike(rf"\A{_TEMPLATE}\z") & (steps == ""), "template").otherwise("unknown")
            )
            rows = written(work.withColumn("sort", kind), "atoms")
            text = F.when(quoted, F.substring("expr", F.lit(2), F.char_length("expr") - 2)).otherwise(e)
            of_value = F.when(e.isin("true", "false"), atom("bool", e)).when(e.isin("undefined", "null", "void 0"), atom("undef")).otherwise(atom("str", text))
            call = e.rlike(r"\A[\w$.]+\(")
            why = F.when(F.col("sort") == "deep", F.concat(F.lit("too deep: "), e)).when(call, F.concat(F.lit("the result of a function call "), e)).otherwise(e)
            ended = rows.where("sort IN ('value', 'undef', 'unknown', 'deep')").select("key", F.when(F.col("sort") == "value", of_value).when(F.col("sort") == "undef", atom("undef")).otherwise(atom("unknown", why)).alias("a"))
            names = rows.where("sort = 'name'").select("key", *place, F.regexp_extract("expr", ident, 1).alias("id"), F.concat(F.regexp_extract("expr", ident, 2), "steps").alias("steps"))
            names = written(names.distinct().withColumn("row", F.monotonically_increasing_id()), "names")
            bound = written(scopes.innermost(names, self.spans, ["path", "seq", "id"], first="prior"), "bound")
            left = names.join(bound.select("row"), "row", "left_anti")
            near = left.join(self.tops, ["path", "id"])
            left = written(left.join(near.select("row").distinct(), "row", "left_anti"), "left")
            far = left.join(self.remote, ["path", "id"])
            lost = left.join(far.select("row").distinct(), "row", "left_anti").unionByName(bound.where("kind = 'lambda'").select(*left.columns))
            first = F.regexp_extract("steps", r"\A\??\.([\w$]+)", 1)
            prop = F.when(F.col("kind") == "param", atom("prop", F.col("value"), F.col("steps"))).when(first != "", atom("prop", first, F.regexp_replace("steps", r"\A\??\.[\w$]+", ""))).otherwise(atom("unknown", F.concat("id", F.lit(" is all properties"))))
            ended = ended.unionByName(bound.where("kind IN ('param', 'whole')").select("key", prop.alias("a"))).unionByName(lost.select("key", atom("unknown", F.concat(F.lit("'"), "id", F.lit("' could not be found"))).alias("a")))
            done = ended if done is None else done.unionByName(ended)
            # Templates: their parts are traced under keys of their own, and put together at the end.
            pieces = F.regexp_extract_all("expr", F.lit(rf"\$\{{({_INSIDE})\}}"), F.lit(1))
            made = rows.where("sort = 'template'").withColumn("id", F.sha2(F.concat_ws("\x1e", *columns), 256)).withColumn("pieces", pieces)
            made = written(made, "templates")
            templates = made if templates is None else templates.unionByName(made)
            parts = made.select(F.explode("pieces").alias("expr"), "id", *place, F.lit("").alias("steps")).withColumn("key", F.concat_ws("\x1e", "id", "expr"))
            stepped = rows.where("sort = 'table'").withColumn("m", F.explode(_members(F.col("expr"), F.col("steps")))).select("key", *place, "m.expr", "m.steps")
            local = bound.where("kind = 'const'").select("key", "path", "seq", F.col("decl_at").alias("at"), F.col("value").alias("expr"), "steps")
            top = near.select("key", "path", F.col("to_seq").alias("seq"), F.lit(1).alias("at"), F.col("to_expr").alias("expr"), "steps")
            away = far.select("key", F.col("to_path").alias("path"), F.col("to_seq").alias("seq"), F.lit(1).alias("at"), F.col("to_expr").alias("expr"), "steps")
            new = _branched(reduce(DataFrame.unionByName, [stepped, local, top, away, parts.select(*columns)])).select(*columns).distinct()
            work = written(new.join(seen, columns, "left_anti"), "work")
            if work.isEmpty():
                break
            seen = seen.unionByName(work)
        done = written(done.distinct(), "done")
        return self._with_templates(done, templates)

    def _with_templates(self, done: DataFrame, templates: DataFrame) -> DataFrame:
        """Atoms by key, with the templates whose parts are known put in, until none is left."""
        templates = written(templates.select("id", "key", F.expr("substring(expr, 2, char_length(expr) - 2)").alias("text"), "pieces"), "templates")
        while not templates.isEmpty():
            part = templates.select("id", "key", "text", F.explode(F.array_distinct("pieces")).alias("piece")).withColumn("part", F.concat_ws("\x1e", "id", "piece"))
            waiting = part.join(templates.select(F.col("key").alias("part")).distinct(), "part", "left_semi").select("id").distinct()
            ready = part.join(waiting, "id", "left_anti")
            said = done.groupBy(F.col("key").alias("part")).agg(F.collect_set("a").alias("said"))
            given = ready.join(said, "part").groupBy("id", "key", "text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("${"), "piece", F.lit("}")), "said"))).alias("given"))
            holes = F.transform(F.map_keys("given"), lambda k: k)
            put = given.select("key", F.explode(summaries.filled(F.col("text"), holes, lambda h: summaries.texts_of(F.element_at("given", h)), self.longest)).alias("a"))
            rest = written(templates.join(waiting, "id", "left_semi"), "templates")
            if rest.count() == templates.count():  # a template within itself
                put = put.unionByName(rest.select("key", atom("unknown", F.lit("a template that contains itself")).alias("a")))
                rest = rest.limit(0)
            done, templates = written(done.unionByName(put).distinct(), "done"), rest
        return done.groupBy("key").agg(F.collect_set("a").alias("said"))


def _branched(work: DataFrame) -> DataFrame:
    return work.withColumn("expr", F.explode(branches(F.col("expr"))))


def _members(e: Column, steps: Column) -> Column:
    """What the first of some member accesses on a table leads to, with those that are left. A written key gives its value, any other index all values
    (of items with that key, for an array of objects)."""
    step = r"\A\??\.?(\[(?:[^\[\]]|\[[^\[\]]*\])*\]|[\w$]+)"
    first, rest = F.regexp_extract(steps, step, 1), F.regexp_replace(steps, step, "")
    key = F.regexp_extract(first, r"\A\[\s*['\"]([^'\"]*)['\"]\s*\]\z|\A([\w$]+)\z", 1)
    key = F.when(key != "", key).otherwise(F.regexp_extract(first, r"\A([A-Za-z_$][\w$]*)\z", 1))
    index = F.regexp_extract(first, r"\A\[\s*(\d+)\s*\]\z", 1)
    pairs = F.transform(_zip(F.regexp_replace(e, r"\A\{|\}\z", ""), _PAIR, a=1, b=2, c=3, v=4), lambda p: F.struct(F.concat(p["a"], p["b"], p["c"]).alias("k"), p["v"].alias("v")))
    of_key = F.transform(F.filter(pairs, lambda p: (key == "") | (p["k"] == key)), lambda p: p["v"])
    items = _all(F.regexp_replace(e, r"\A\[|\]\z", ""), _BRACES + "|" + _BRACKETS + "|" + _STRING + r"|`[^`]*+`|[\w$.]+(?:" + _PARENS + ")?", 0)
    of_index = F.when(index != "", F.filter(F.array(F.get(items, index.cast("int"))), lambda x: x.isNotNull())).otherwise(items)
    missing = F.array(F.lit("undefined"))
    stepped = F.when(e.startswith("{"), F.when(F.size(of_key) > 0, of_key).otherwise(missing)).when(first == "length", F.array(F.lit("array.length()"))).otherwise(F.when(F.size(of_index) > 0, of_index).otherwise(missing))
    return F.transform(stepped, lambda v: F.struct(F.trim(v).alias("expr"), rest.alias("steps")))


def _collected(done, instances, names, files, imps, wrappers, called, n_sites, default_variant) -> Usage:
    at = instances.select("instance", "site", "path", "line")
    unknown = done.where("kind = 'unknown'").select("instance", "attr", "value")
    why = unknown.where("attr = 'name'").groupBy("instance").agg(F.min("value").alias("why"))
    shapes = done.where("attr = 'filled'").select("instance", F.explode(F.when(F.col("kind") == "unknown", F.array(F.lit("d"), F.lit("f"))).when((F.col("kind") == "bool") & (F.col("value") == "true"), F.array(F.lit("f"))).when((F.col("kind") == "str") & (F.col("value") != ""), F.array(F.lit("f"))).otherwise(F.array(F.lit("d")))).alias("shape")).distinct()
    variants = done.where("attr = 'variant'").select("instance", F.when(F.col("kind") == "unknown", "*").when(F.col("kind") == "str", F.col("value")).otherwise(F.lit(default_variant)).alias("variant")).distinct()
    said = done.where("attr = 'name' AND kind = 'str'").select("instance", F.col("value").alias("name"))
    # The names of the file, and of the files it imports, for sites whose name is not known. Only those files are read.
    near = resolve_imports(imps, files).select("path", F.col("resolved").alias("near")).union(files.select("path", "path")).distinct()
    lost = written(why.join(at, "instance"), "lost")
    asked = lost.select("path", "instance").join(near, "path")
    wanted = files.join(asked.select(F.col("near").alias("path")).distinct(), "path", "left_semi")
    code = wanted if "code" in files.columns else with_code(wanted)
    here = written(code.select("path", F.explode(T.value_literals(F.col("code"), F.col("path"))).alias("name")).join(names.select("name").distinct(), "name", "left_semi"), "names-here")
    taken = asked.join(here.withColumnRenamed("path", "near"), "near").select("instance", "name", "near")
    rows = said.unionByName(taken.select("instance", "name")).join(names.select("name").distinct(), "name", "left_semi")
    uses = rows.join(variants, "instance").join(shapes, "instance").select("variant", "name", "shape").distinct()
    d_name = lost.select("path", "line", F.concat(F.lit("name could not be resolved ("), "why", F.lit("); the names written in this file and the files it imports are included")).alias("message"))
    other = unknown.where("attr <> 'name'").join(at, "instance").select("path", "line", F.concat("attr", F.lit(" could not be resolved ("), "value", F.lit("); every one is included")).alias("message"))
    uncalled = wrappers.join(called.withColumnRenamed("node", "target"), "target", "left_anti").select("path", F.lit(1).alias("line"), F.concat(F.lit("wrapper "), "component", F.lit(" has no call sites that could be traced")).alias("message"))
    diagnostics = d_name.unionByName(other).unionByName(uncalled).distinct()
    return Usage(uses=uses, diagnostics=diagnostics, fallback_files=taken.select(F.col("near").alias("path")).distinct(), sites=n_sites, wrappers=wrappers.select("path", "component").distinct())
