"""Functions paired with their documentation, by packrat grammars with retained source offsets."""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.peg import Rules, State, absent, act, ahead, alt, many, opt, rx, seq


@dataclass
class Found:
    """A function or class with the offsets of its parts; ``doc`` is its documentation, if any."""

    kind: str
    name: str
    start: int
    end: int
    params: str = ""
    returns: str = ""
    doc: str | None = None
    inner: list[Found] = field(default_factory=list)


def _flat(values) -> list[Found]:
    out: list[Found] = []
    stack = [values]
    while stack:
        v = stack.pop()
        if isinstance(v, Found):
            out.append(v)
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def _python_grammar() -> Rules:
    """The statement structure of Python: logical lines, strings, brackets, indented blocks, definitions."""
    g = Rules()
    newline = rx(r"\r\n|\r|\n|\Z")
    blank = rx(r"[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\r|\n)|[ \t\f]*#[^\r\n]*\Z|[ \t\f]+\Z")
    space = rx(r"(?:[ \t\f]|\\(?:\r\n|\r|\n))*")
    inside_space = rx(r"(?:[\s\f]|\\(?:\r\n|\r|\n)|#[^\r\n]*)*")
    string = rx(
        r"(?:[rRbBuUfFtT]{0,2})(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\""
        r"|'(?:[^\\'\r\n]|\\(?:\r\n|.))*'|\"(?:[^\\\"\r\n]|\\(?:\r\n|.))*\")",
        re.DOTALL,
    )
    plain_run = rx(r"[^\s\f\"'#\\()\[\]{}:;]+|[ \t\f]+")
    g.define("string", string)
    bracket_item = alt(rx(r"[^\"'#\\()\[\]{}]+"), g["string"], rx(r"#[^\r\n]*"), rx(r"\\(?:\r\n|\r|\n)?"), g["bracketed"])
    inner = many(bracket_item)
    g.define("bracketed", alt(seq(rx(r"\("), inner, rx(r"\)")), seq(rx(r"\["), inner, rx(r"\]")), seq(rx(r"\{"), inner, rx(r"\}"))))
    joined = rx(r"\\(?:\r\n|\r|\n)")
    piece = alt(g["string"], plain_run, g["bracketed"], joined)
    g.define("line", seq(many(alt(piece, rx("[:;]"))), opt(rx(r"#[^\r\n]*")), newline))

    # a docstring: string literals that make up the whole first statement of a body
    literals = seq(g["string"], many(seq(space, g["string"])))
    inside_literals = seq(g["string"], many(seq(inside_space, g["string"])))
    g.define("wrapped", seq(rx(r"\("), inside_space, alt(inside_literals, g["wrapped"]), inside_space, rx(r"\)")))
    statement_end = ahead(seq(space, rx(r";|#|\r|\n|\Z")))
    g.define("docstring", act(seq(alt(literals, g["wrapped"]), statement_end), lambda s, a, b, v: ("doc", _text_of(s.text, v))))

    def block(s: State, at: int):
        """Statements of one indentation, deeper than that of the statement above."""
        while (r := blank(s, at)) is not None and r[0] > at:
            at = r[0]
        column, start = _column(s.text, at)
        if start >= len(s.text) or column <= s.column:
            return None
        outer, s.column = s.column, column
        values, doc = [], None
        if (r := g["docstring"](s, start)) is not None:
            doc = r[1]
        while True:
            r = g["statement"](s, start)
            if r is None:
                break
            at = r[0]
            values.append(r[1])
            while (r := blank(s, at)) is not None and r[0] > at:
                at = r[0]
            here, start = _column(s.text, at)
            if start >= len(s.text) or here != column:
                break
        s.column = outer
        return at, [doc, values]

    g.define("block", block)
    inline_doc = act(seq(space, ahead(g["docstring"]), g["docstring"], g["line"]), lambda s, a, b, v: [v[2], []])
    body = alt(
        act(seq(space, opt(rx(r"#[^\r\n]*")), newline, g["block"]), lambda s, a, b, v: v[3]),
        inline_doc,
        act(g["line"], lambda s, a, b, v: [None, []]),
    )
    name = rx(r"[^\W\d]\w*")
    type_params = opt(alt(seq(ahead(rx(r"\[")), g["bracketed"])))
    returns = opt(seq(rx("->"), many(piece)))

    def function(s: State, a: int, b: int, v) -> Found:
        span = v[2]
        doc, children = v[-1]
        return Found("function", s.text[span[0] : span[1]], a, v[9][1], s.text[v[6] : v[7]], "" if not v[8] else s.text[v[7] : v[9][0]], doc[1] if doc else None, _flat(children))

    def mark(s: State, at: int):
        return at, at

    g.define(
        "function",
        act(
            seq(rx(r"(?:async(?:[ \t\f]|\\(?:\r\n|\r|\n))+)?def(?=[ \t\f\\])"), space, name, space, type_params, space, mark, act(g["bracketed"], lambda s, a, b, v: b), act(seq(space, returns, space), lambda s, a, b, v: v[1]), rx(":"), body),
            function,
        ),
    )
    g.define(
        "class",
        act(
            seq(rx(r"class(?=[ \t\f\\])"), space, name, space, type_params, space, opt(g["bracketed"]), space, rx(":"), body),
            lambda s, a, b, v: Found("class", s.text[v[2][0] : v[2][1]], a, v[8][1], doc=None, inner=_flat(v[9][1])),
        ),
    )
    other = act(seq(absent(newline), g["line"], opt(g["block"])), lambda s, a, b, v: [] if v[2] is None else v[2][1])
    g.define("statement", alt(g["function"], g["class"], other))
    g.define("file", act(seq(opt(rx("\ufeff")), opt(g["block"])), lambda s, a, b, v: [] if v[1] is None else _flat(v[1][1])))
    return g


def _column(text: str, at: int) -> tuple[int, int]:
    """Indentation at the beginning of a line, and where it ends; tabs go to multiples of eight."""
    column = 0
    n = len(text)
    while at < n:
        c = text[at]
        if c == " ":
            column += 1
        elif c == "\t":
            column = column // 8 * 8 + 8
        elif c == "\f":
            column = 0
        else:
            break
        at += 1
    return column, at


_LITERAL = re.compile(r"([A-Za-z]*)['\"]")


def _text_of(text: str, values) -> str | None:
    """The value of adjacent string literals; None if one is not plain text (bytes, formatted) or cannot be read."""
    spans: list[tuple[int, int]] = []

    def walk(v) -> None:
        if isinstance(v, tuple):
            spans.append(v)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(values)
    out = []
    for a, b in spans:
        literal = text[a:b]
        m = _LITERAL.match(literal)
        if not m:
            continue
        if set(m[1].lower()) - {"r", "u"}:
            return None
        try:
            out.append(ast.literal_eval(literal))
        except (SyntaxError, ValueError):
            return None
    return "".join(out) if out else None


def _c_like_grammar() -> Rules:
    """Languages with braces: a ``/** */`` comment right before a function or method."""
    g = Rules()
    space = rx(r"\s*")
    doc = rx(r"/\*\*(?!/).*?\*/", re.DOTALL)
    comment = rx(r"/\*.*?\*/|//[^\n]*", re.DOTALL)
    text = rx(r"\"(?:[^\\\"\n]|\\.)*\"|'(?:[^\\'\n]|\\.)*'|`(?:[^\\`]|\\.)*`", re.DOTALL)
    inner = many(alt(rx(r"[^\"'`()/]+"), text, comment, rx("/"), g["parens"]))
    g.define("parens", seq(rx(r"\("), inner, rx(r"\)")))
    words = rx(r"(?:(?!(?:if|for|while|switch|catch|return|new|else)\b)[\w$.<>\[\],?*&:]+\s+)*")
    name = rx(r"(?!(?:if|for|while|switch|catch|return)\b)[^\W\d][\w$]*|\$[\w$]*")
    after = rx(r"\s*(?::\s*[\w$.<>\[\]|, ]+|throws\s+[\w., ]+|[\w$.\[\]*]+)?\s*(?=\{)")

    def function(s: State, a: int, b: int, v) -> Found:
        raw = s.text[v[0][0] + 3 : v[0][1] - 2]
        lines = [re.sub(r"^[ \t]*\*? ?", "", x) for x in raw.splitlines()]
        return Found("function", s.text[v[3][0] : v[3][1]], v[2][0], b, s.text[v[5] : v[6]], doc="\n".join(lines).strip())

    here = lambda s, at: (at, at)
    g.define("function", act(seq(doc, space, words, name, space, here, act(g["parens"], lambda s, a, b, v: b), after), function))
    g.define("file", act(many(alt(g["function"], comment, text, rx(r"[^\"'`/]+?(?=/\*\*|[\"'`/]|\Z)"), rx("[/\"'`]"))), lambda s, a, b, v: _flat(v)))
    return g


def _valid_python(source: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source.removeprefix("\ufeff"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


@dataclass(frozen=True)
class Language:
    """Grammar of a language and the check a whole file must pass."""

    grammar: Rules
    valid: Callable[[str], bool]


#: Languages by the end of a file's path; register another by adding it.
LANGUAGES: dict[str, Language] = {".py": Language(_python_grammar(), _valid_python)}
LANGUAGES |= dict.fromkeys([".js", ".ts", ".java"], Language(_c_like_grammar(), lambda source: True))

_ARTICLES = {"a", "an", "the", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une"}
_NAME_PART = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Phrases that stand for missing documentation, in lower-case words with single blanks (fixed values).
_MARK = r"(?:todo|to do|fixme|xxx|tbd|tba|tbc|wip|placeholder)"
_THING = r"(?:docs?|docstrings?|doc strings?|documentation|description|summary)"
_REMARK = re.compile(
    "|".join(
        [
            rf"{_MARK}(?: {_MARK})*",
            rf"(?:{_MARK} )?{_THING}",
            rf"(?:{_MARK} )?(?:add|write|insert|put|provide|update|fill in|needs?|no|without|missing)(?: an?| the| your| some)?(?: proper)? {_THING}(?: here| later| soon| yet| available| provided| given| needed| required| for this(?: function| method)?)*",
            rf"(?:{_MARK} )?{_THING} (?:is |are )?(?:still )?(?:missing|needed|required|pending|unavailable|to follow|follows|goes here|here|later|coming soon|to be (?:added|written|done)|not (?:yet )?(?:available|written|provided|given)(?: yet)?)",
            rf"(?:{_MARK} )?(?:still )?to be (?:documented|written|described|added|done|completed|determined|filled in)(?: later| soon)?",
            rf"(?:{_MARK} )?(?:please )?(?:document|describe|fill in)(?: me| this| it)?(?: function| method)?(?: here| later| please)*",
            r"not (?:yet )?(?:documented|described|written|available|applicable)(?: yet)?",
            r"undocumented(?: function| method)?",
            r"n a|na|none|null|nil|nothing(?: here)?",
            r"(?:noch )?keine? (?:beschreibung|dokumentation)(?: vorhanden)?|(?:beschreibung|dokumentation) (?:fehlt|folgt)(?: noch)?|(?:ist )?noch zu (?:dokumentieren|beschreiben)",
            r"(?:sans|aucune|pas de) (?:documentation|description)|(?:documentation|description) manquante|[aà] (?:documenter|faire|compl[eé]ter)",
        ]
    )
)
_LABELS = {"args", "arg", "arguments", "argument", "parameters", "parameter", "params", "param", "returns", "return", "rtype", "type", "types", "yields", "yield", "raises", "raise", "keyword", "kwargs", "result", "results", "output", "outputs", "input", "inputs"}
_TYPES = {"int", "integer", "str", "string", "float", "double", "bool", "boolean", "bytes", "bytearray", "dict", "list", "tuple", "set", "frozenset", "none", "any", "object", "optional", "callable", "iterable", "iterator", "sequence", "mapping", "union", "type", "complex", "number", "array", "of", "or"}


def _parts(text: str) -> list[str]:
    return [p.lower() for p in _NAME_PART.findall(_CAMEL.sub(" ", text))]


def uninformative(doc: str, name: str, params: str = "", returns: str = "") -> bool:
    """Whether documentation says nothing: no letter or digit, a stock remark as a whole, the name again, or no word beside names of parameters and bare types."""
    found = [w.lower() for w in re.findall(r"[^\W_]+", doc)]
    if not found:
        return True
    if _REMARK.fullmatch(" ".join(w for w in found if not w.isdigit())):
        return True
    said = [p for p in _parts(doc) if p not in _ARTICLES]
    own = [p for p in _parts(name) if p not in _ARTICLES] or _parts(name)
    if "".join(said or _parts(doc)) == "".join(own):
        return True
    names = {w.lower() for w in re.findall(r"\w+", params + " " + returns)} | {"self", "cls"}
    return all(w in names or w in _LABELS or w in _TYPES for w in (x.lower() for x in re.findall(r"\w+", doc)))


#: Frames a grammar may use; a bracket takes about 5, a nested definition about 10.
DEPTH = 10_000
_LINE_END = re.compile(r"\r\n|\r|\n")


def module_path(path: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(p for p in parts if p not in ("", "."))


def extract(path: str, source: str) -> list[tuple]:
    """(qualified_name, name, signature, docstring, start_line, start, end) of a file's documented functions.

    A file in a language without grammar, or that does not pass its language's check, gives none; nor does one
    nested deeper than DEPTH frames, which is beyond what Python itself parses (200 brackets, 100 indentations).
    """
    language = next((v for k, v in LANGUAGES.items() if path.endswith(k)), None)
    if language is None or not source:
        return []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    try:
        _, found = language.grammar["file"](State(source), 0)
    except RecursionError:
        return []
    out: list[tuple] = []
    ends = [m.start() for m in _LINE_END.finditer(source)]
    stack = [(f, module_path(path)) for f in reversed(found)]
    at = 0
    while stack:
        f, scope = stack.pop()
        full = f"{scope}.{f.name}" if scope else f.name
        if f.kind == "function" and f.doc is not None and not uninformative(f.doc, f.name, f.params, f.returns):
            while at < len(ends) and ends[at] < f.start:
                at += 1
            out.append((full, f.name, re.sub(r"\s+", " ", source[f.start : f.end]), f.doc, at + 1, f.start, f.end))
        stack.extend((x, full) for x in reversed(f.inner))
    return out if out and language.valid(source) else []


_SCHEMA = "file_id string, path string, qualified_name string, name string, signature string, docstring string, start_line int, start int, end int"


def documented_functions(files: DataFrame, key: str = "file_id", path: str = "path", source: str = "content") -> DataFrame:
    """(file_id, path, qualified_name, name, signature, docstring, start_line, start, end) of every documented function or method.

    Files are parsed independently by the grammar of their path's ending; offsets are in characters, lines from 1.
    Functions whose documentation is missing or says nothing are left out. Null paths or
    sources give nothing, repeated rows repeated pairs; other columns are not read. Nothing is shuffled.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, p, *x) for k, p, s in zip(batch["k"], batch["p"], batch["s"], strict=True) for x in extract(p, s)]
            yield pd.DataFrame(rows, columns=["file_id", "path", "qualified_name", "name", "signature", "docstring", "start_line", "start", "end"])

    picked = files.select(F.col(key).cast("string").alias("k"), F.col(path).alias("p"), F.col(source).alias("s")).where("p is not null and s is not null")
    return picked.mapInPandas(parse, _SCHEMA)
