"""Which quoted tokens of code stand where a value stands: a fold over its tokens.

One possessive pattern cuts the code into tokens (strings, templates, regular expressions, words, brackets, marks, line ends); comments
match it as empty ones. aggregate() then goes over the tokens once with a small state:

* stack: a letter for each open bracket, with marks for what a colon may still belong to. ( [ { as they are, f the body of a function, c of
  a class; ? a conditional or a case that waits for its colon, d a declaration (const, let, var), k the head of a class, J a tag, T the text in it.
* mode: "" among values; "t" in a type, "h" before the = of a type alias, "i" in an interface, "g" in angle brackets.
* inner: the brackets of the type itself; marks: x an extends that waits for its question mark, y one that waits for its colon; need: an operand is due.
* prev: the last token, or "use?" after a quoted one that is a directive if its statement ends here, and "use" if it did; names: what was found.

A type begins at a colon that belongs to a parameter, a declaration, a field or a return, at as and satisfies, at an alias, an interface and
type arguments. It ends where the next token can't go on with it, so a line end ends it only if the next line begins with something else
than an operator of types: code without semicolons needs no special case. What isn't understood counts as a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quotation mark right after a letter is an apostrophe (as text between tags has them), unless a keyword ends there.
_OPEN = r"(?=['\"])(?:(?<![\w$])|(?<=\b(?:return|case|from|import|typeof|of|in|else|await|yield|extends)))"
STRING = _OPEN + r"(?:'[^'\\\n]*(?:\\.[^'\\\n]*)*+'|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*+\")"
_PART = r"\$\{(?:[^{}`]++|\{[^{}`]*+\}|`[^`]*+`)*+\}"
TEMPLATE = r"`(?:[^`\\$]++|\\(?s:.)|\$(?!\{)|" + _PART + r")*+`"
REGEX = r"/(?<=(?:[=(,:!&|?;\[{\n>][ \t]{0,4}|return )/)(?![*/>])(?:[^/\\\n\[]|\\.|\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*+\])++/[a-z]*+"
_ALIAS = r"type[ \t]++(?<=(?:\A|[;{}\n]|\bexport|\bdeclare)[ \t]{0,60}type[ \t]{1,9})[\w$]++(?:(?=\s*+=[^=>])|\s*+<)"
_INTERFACE = r"interface\s++[\w$]++(?=[^;(){}]*+\{)"
_HEAD = r"(?:function(?:\s*+\*)?|class)\s++[\w$]++\s*+<"
_ANGLE = r"(?:[^<>;={}]|=>|\{[^{}=]*+\}|<(?:[^<>;={}]|=>|<(?:[^<>;={}]|=>)*+>)*+>)*+"
_WORD = r"[\w$]++(?:\??\.[\w$]++)*+(?:<(?=" + _ANGLE + r">))?+"
_TAG = r"<(?:\s*+(?:const\s++)?[\w$]++\s++extends\b|/[\w$.:-]*+\s*+>|>|[A-Za-z_$][\w$.:-]*+(?=[\s/>])|=?+)"
#: A group of its own for what counts, so that comments come out empty.
TOKEN = rf"[ \t\r]*+(?:(?:/\*(?s:.*?)\*/|//[^\n]*+|://)|((?=[a-z])(?:{_ALIAS}|{_INTERFACE}|{_HEAD})|{_WORD}|\n|{STRING}|[(),;{{}}\[\]]|=>|[?!]\s*+:|\?[?.]|&&|\|\||{_TAG}|[=!>]=++|{TEMPLATE}|{REGEX}|[^\s.]))"

_NAME = r"'[a-z0-9_]+'|\"[a-z0-9_]+\"|`[a-z0-9_]+`"
_START = {"stack": "''", "mode": "''", "inner": "''", "marks": "''", "need": "false", "line": "false", "prev": "''", "names": "cast(array() as array<string>)"}
_QUOTE, _WORD_START = r"rlike(t, '\\A[\'\"`]')", "(ascii(t) BETWEEN 97 AND 122 OR ascii(t) BETWEEN 65 AND 90 OR ascii(t) BETWEEN 48 AND 57 OR t LIKE '$%' OR t LIKE '\\_%')"


def _sql(text: str) -> str:
    """A SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _isin(x: str, *values: str) -> str:
    return f"{x} IN ({', '.join(map(_sql, values))})"


def _state(**changed: str) -> str:
    """s with some fields set."""
    return "named_struct(" + ", ".join(f"'{f}', {changed.get(f, f's.{f}')}" for f in _START) + ")"


def _cases(*rows: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rows) + f" ELSE {otherwise} END"


def _to(**changed: str) -> str:
    """The state after a token that is done with."""
    return _state(**({"line": "false", "prev": "t"} | changed))


def _pop(stack: str) -> str:
    return f"left({stack}, length({stack}) - 1)"


#: The names of a quoted token: itself, or those quoted in the parts of a template.
_FOUND = (
    f"CASE WHEN rlike(t, {_sql(rf'\A(?:{_NAME})\z')}) THEN array(substring(t, 2, length(t) - 2)) WHEN t LIKE '`%' AND contains(t, '${{') THEN "
    f"transform(regexp_extract_all(array_join(regexp_extract_all(t, {_sql(_PART)}, 0), '\\n'), {_sql(_NAME)}, 0), q -> substring(q, 2, length(q) - 2)) ELSE cast(array() as array<string>) END"
)
#: Can the last token end an operand?
_OPERAND = "(rlike(s.prev, " + _sql(r"[\w$'\"`)\]}]\z") + ") AND NOT " + _isin("s.prev", *"return case import export default typeof in of else await yield extends new throw delete void instanceof".split()) + ")"
#: The type ended before the token, which is still to be read. A parenthesis before it is the least that can be said.
_OVER = _state(mode="''", inner="''", marks="''", need="false", prev="')'")


def _in_type() -> str:
    """The state after a token in a type. Mode is "" where the type ended before the token, and ! where the token completed it."""
    angle = "right(t, 1) = '<'"
    matching = "CASE t WHEN ')' THEN '(' WHEN ']' THEN '[' WHEN '}' THEN '{' ELSE '<' END"
    completes = "length(s.inner) = 1 AND (s.mode = 'g' OR (s.mode = 'i' AND t = '}'))"
    deep = _cases(
        (_isin("t", "(", "[", "{"), _to(inner="concat(s.inner, t)")),
        (angle, _to(inner="concat(s.inner, '<')")),
        ("t = '>' AND right(s.inner, 1) <> '<'", _to()),
        (_isin("t", ")", "]", "}", ">") + f" AND right(s.inner, 1) <> {matching}", _OVER),
        (_isin("t", ")", "]", "}", ">") + f" AND {completes}", _state(mode="'!'", inner="''", marks="''", need="false", line="false", prev="CASE WHEN s.mode = 'g' THEN 'x' ELSE ';' END")),
        (_isin("t", ")", "]", "}", ">"), _to(inner=_pop("s.inner"), need="false")),
        otherwise=_to(),
    )
    asks, answers = "t = '?' AND right(s.marks, 1) = 'x'", "t = ':' AND right(s.marks, 1) = 'y'"
    word = _cases(
        ("t = 'extends' AND NOT s.need", _to(need="true", marks="concat(s.marks, 'x')")),
        ("t = 'is' AND NOT s.need", _to(need="true")),
        ("s.need AND " + _isin("t", *"keyof typeof readonly unique infer new abstract asserts".split()), _to()),
        ("s.need OR s.mode <> 't'", _to(need="false")),
        otherwise=_OVER,
    )
    flat = _cases(
        ("s.line AND NOT s.need AND s.mode = 't' AND NOT (" + _isin("t", "|", "&", "=>", "extends", "is") + f" OR ({asks}) OR ({answers}))", _OVER),
        (f"{angle} AND NOT (s.need AND t = '<')", _to(inner="'<'", need="false")),
        (_WORD_START, word),
        (f"{_QUOTE} AND s.need", _to(need="false")),
        (_isin("t", "|", "&"), _to(need="true")),
        (_isin("t", "(", "[", "{") + " AND (s.need OR s.mode = 'i' OR (t = '[' AND NOT s.line))", _to(inner="t", need="false")),
        ("t = '=>' AND s.prev = ')' AND NOT s.need", _to(need="true")),
        ("t = '=' AND s.mode = 'h'", _to(mode="'t'", need="true")),
        (asks, _to(need="true", marks=f"concat({_pop('s.marks')}, 'y')")),
        (answers, _to(need="true", marks=_pop("s.marks"))),
        ("(t = '-' AND s.need) OR (t = ',' AND s.mode = 'i')", _to()),
        otherwise=_OVER,
    )
    return _cases(("t = '\\n'", _state(line="true")), ("s.inner <> ''", deep), otherwise=flat)


def _among_values() -> str:
    push = lambda mark: _to(stack=f"concat(s.stack, {mark})")
    in_type = lambda mode, need="false", inner="''", stack="s.stack": _to(mode=f"'{mode}'", need=need, inner=inner, stack=stack)
    top, bare = "right(s.stack, 1)", r"regexp_replace(s.stack, '[?dkJT]+\\z', '')"
    # A directive counts until its statement ends.
    names = "CASE WHEN s.prev = 'use?' THEN slice(s.names, 1, size(s.names) - 1) ELSE s.names END"
    first = f"(s.prev IN ('', 'use') OR (s.prev = '{{' AND {top} = 'f')) AND t NOT LIKE '`%'"
    quoted = _cases(
        ("s.prev IN ('from', 'import')", _to()),
        (first, _to(names=f"concat(s.names, {_FOUND})", prev=f"CASE WHEN size({_FOUND}) > 0 THEN 'use?' ELSE 'use' END")),
        otherwise=_to(names=f"concat(s.names, {_FOUND})"),
    )
    keyword = _cases(
        ("t = 'case' OR (t = 'default' AND s.prev <> 'export')", push("'?'")),
        (f"t IN ('const', 'let', 'var') AND {top} <> 'd'", push("'d'")),
        ("t = 'class'", push("'k'")),
        (f"t IN ('as', 'satisfies') AND {top} <> 'T' AND {_OPERAND}", in_type("t", "true")),
        otherwise=_to(),
    )
    word = _cases(
        (_isin("t", "case", "default", "const", "let", "var", "class", "as", "satisfies"), keyword),
        (r"right(t, 1) = '<' AND rlike(t, '\\Atype\\s')", in_type("h", inner="'<'")),
        (r"right(t, 1) = '<' AND rlike(t, '\\Aclass\\s')", in_type("g", inner="'<'", stack="concat(s.stack, 'k')")),
        ("right(t, 1) = '<'", in_type("g", inner="'<'")),
        (r"rlike(t, '\\s')", _cases(("t LIKE 'type%'", in_type("h")), otherwise=in_type("i"))),
        otherwise=_to(),
    )
    tag = _cases(
        ("t LIKE '</%'", _to(stack=f"CASE WHEN {top} = 'T' THEN {_pop('s.stack')} ELSE s.stack END", prev="'>'")),
        (f"{top} = 'T' OR NOT {_OPERAND}", push("CASE WHEN t = '<>' THEN 'T' ELSE 'J' END")),
        otherwise=_to(),
    )
    # A colon that no conditional waits for begins a type after a parameter, a declared name, a field or the brackets of a parameter list.
    colon = _cases(
        (f"{top} IN ('?', 'k')", _to(stack=_pop("s.stack"))),
        (f"{top} IN ('(', 'd', 'c') OR (s.prev = ')' AND {top} <> 'T')", in_type("t", "true")),
        otherwise=_to(),
    )
    body = f"CASE WHEN {top} = 'k' THEN concat({_pop('s.stack')}, 'c') WHEN s.prev IN (')', '=>') THEN concat(s.stack, 'f') ELSE concat(s.stack, '{{') END"
    return _cases(
        (_WORD_START, word),
        (_QUOTE, quoted),
        ("t IN ('(', '[')", push("t")),
        ("t = '{'", _to(stack=body)),
        ("t IN (')', ']', '}')", _to(stack=_pop(bare))),
        ("t = '\\n'", _state(line="true", names=names, prev="CASE WHEN s.prev = 'use?' THEN 'use' ELSE s.prev END")),
        ("t = ';'", _to(stack=bare, names=names, prev="CASE WHEN s.prev IN ('use', 'use?') THEN 'use' ELSE t END")),
        ("t = ':'", colon),
        ("t = '?'", push("'?'")),
        (r"rlike(t, '\\A[?!]\\s*:\\z')", in_type("t", "true")),
        ("t LIKE '<%extends'", in_type("g", inner="'<'")),
        ("row.tags AND t LIKE '<%' AND t NOT IN ('<', '<=')", tag),
        (f"t = '>' AND {top} = 'J'", _to(stack=f"concat({_pop('s.stack')}, CASE WHEN s.prev = '/' THEN '' ELSE 'T' END)")),
        (f"t = '=' AND {top} = 'k'", _to(stack=_pop("s.stack"))),
        otherwise=_to(),
    )


def _fold() -> str:
    """The fold as a SQL lambda over rows of tokens and tags. A type that ended before a token leaves it to be read among values."""
    typed = f"CASE WHEN s.mode = '' THEN s ELSE {_in_type()} END"
    read = _cases(("s.mode = '!'", _state(mode="''")), ("s.mode = ''", _among_values()), otherwise="s")
    start = "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in _START.items()) + ")"
    return f"row -> aggregate(row.tokens, {start}, (s, t) -> CASE WHEN t = '' THEN s ELSE transform(array({typed}), s -> {read})[0] END, s -> array_sort(array_distinct(s.names)))"


def value_names(code: Column, tags: Column | bool = True) -> Column:
    """The distinct name-shaped quoted tokens of value positions, sorted. tags: may the code have tags (else < is a comparison or an assertion)? Null code has none."""
    tags = tags if isinstance(tags, Column) else F.lit(tags)
    tokens = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.call_function("transform", F.array(F.struct(tokens.alias("tokens"), tags.alias("tags"))), F.expr(_fold()))[0]
