"""What functions pass on, composed over their calls.

A row says what a function leads to in terms of its own parameters: (owner, origin, atoms). owner is the function, or null where nothing is open any more;
origin is where the use stands; atoms are what its attributes may be, each of

    str, bool, undef  a value
    prop              the parameter value, then the member accesses steps
    part              a text with parameters in it
    unknown           why it is not known

A call binds the parameters: rows of a function become rows of its callers, with the call's own atoms in place of the parameters. Rows are a set, and only
rows that the last round added are composed with the calls. So chains that a function is reached by are never listed: many paths that pass on
the same are one row, and circles end when they add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

ATOM = "struct<kind:string,value:string,steps:string>"
ATOMS = "array<struct<attr:string,kind:string,value:string,steps:string>>"
#: Texts that one template may stand for.
MOST_TEXTS = 256
_OPEN, _MID, _CLOSE, _PUT = "\x02", "\x1f", "\x03", "\x04"
_HOLE = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"


def atom(kind: str | Column, value: Column | None = None, steps: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if value is None else value).alias("value"), (F.lit("") if steps is None else steps).alias("steps"))


def hole(prop: Column, steps: Column) -> Column:
    """A parameter as it stands in a text."""
    return F.concat(F.lit(_OPEN), prop, F.lit(_MID), steps, F.lit(_CLOSE))


def _once(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def texts_of(atoms: Column) -> Column:
    """What atoms are inside a text; null for one that is not known."""
    return F.array_distinct(F.transform(atoms, lambda a: F.when(a["kind"] == "prop", hole(a["value"], a["steps"])).when(a["kind"] == "undef", F.lit("undefined")).when(a["kind"] != "unknown", a["value"])))


def filled(text: Column, holes: Column, texts_at, longest: int) -> Column:
    """Atoms of a text with holes: every combination of what texts_at gives for each. Too many, or a part that is not known, is one unknown atom; so is a text over longest."""
    lost = F.lit(None).cast("string")

    def fill(done: Column, h: Column) -> Column:
        combined = lambda own: F.when(F.size(done) * F.size(own) > MOST_TEXTS, F.array(lost)).otherwise(F.flatten(F.transform(done, lambda t: F.transform(own, lambda x: F.replace(t, h, F.replace(x, F.lit(_OPEN), F.lit(_PUT)))))))
        return _once(texts_at(h), combined)

    # What is put in may have holes of the same name, which are the caller's; they are marked until all are filled.
    texts = F.array_distinct(F.transform(F.aggregate(F.array_distinct(holes), F.array(text), fill), lambda t: F.replace(t, F.lit(_PUT), F.lit(_OPEN))))
    said = lambda t: F.when(F.contains(t, F.lit(_OPEN)), atom("part", t)).when(F.length(t) <= longest, atom("str", t)).otherwise(atom("unknown", F.lit("a text longer than any name")))
    unknown = F.array(atom("unknown", F.lit("a template of unknown or too many values")))
    return _once(texts, lambda ts: F.when(F.exists(ts, lambda t: t.isNull()), unknown).otherwise(F.transform(ts, said)))


def holes_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_HOLE), F.lit(0))


def _canonical(atoms: Column) -> Column:
    return F.array_sort(F.array_distinct(atoms))


def compose(rows: DataFrame, calls: DataFrame, answers: DataFrame, *, longest: int = 128) -> DataFrame:
    """All rows (owner, origin, atoms) that follow from rows by calls (call, owner, target: owner calls target, null at top level) and answers
    (call, prop, steps, said: the atoms that a call gives for a parameter, in terms of its owner's). A parameter without answer is undef.

    Rounds until one adds nothing, each a written table. Circles that would lengthen a text for ever end at longest.
    """
    keyed = lambda df: df.withColumn("id", F.sha2(F.concat_ws("\x1e", F.coalesce(F.concat(F.lit("+"), "owner"), F.lit("-")), "origin", F.to_json("atoms")), 256))
    rows = keyed(rows.select("owner", "origin", _canonical(F.col("atoms")).cast(ATOMS).alias("atoms"))).dropDuplicates(["id"])
    found = front = written(rows, "summaries")
    answers = answers.select("call", hole(F.col("prop"), F.col("steps")).alias("ref"), "said")
    while True:
        step = front.where("owner IS NOT NULL").select("id", "origin", "atoms", F.col("owner").alias("target")).join(calls, "target")
        refs = F.array_distinct(F.flatten(F.transform("atoms", lambda a: F.when(a["kind"] == "prop", F.array(hole(a["value"], a["steps"]))).when(a["kind"] == "part", holes_of(a["value"])).otherwise(F.array().cast("array<string>")))))
        step = written(step.withColumn("refs", refs), "calls")
        asked = step.where(F.size("refs") > 0).select("id", "call", F.explode("refs").alias("ref")).join(answers, ["call", "ref"])
        given = asked.groupBy("id", "call").agg(F.map_from_entries(F.collect_list(F.struct("ref", "said"))).alias("given"))
        step = step.join(given, ["id", "call"], "left")
        undef = F.array(atom("undef"))
        answer = lambda ref: F.coalesce(F.try_element_at("given", ref), undef)

        def bound(a: Column) -> Column:
            passed = F.when(a["kind"] == "prop", answer(hole(a["value"], a["steps"]))).when(a["kind"] == "part", filled(a["value"], holes_of(a["value"]), lambda h: texts_of(answer(h)), longest)).otherwise(F.array(F.struct(a["kind"].alias("kind"), a["value"].alias("value"), a["steps"].alias("steps"))))
            return F.transform(passed, lambda p: F.struct(a["attr"].alias("attr"), p["kind"].alias("kind"), p["value"].alias("value"), p["steps"].alias("steps")))

        more = keyed(step.select("owner", "origin", _canonical(F.flatten(F.transform("atoms", bound))).cast(ATOMS).alias("atoms"))).dropDuplicates(["id"])
        front = written(more.join(found.select("id"), "id", "left_anti").select("owner", "origin", "atoms", "id"), "summaries")
        if front.isEmpty():
            return found.drop("id")
        found = found.unionByName(front)
