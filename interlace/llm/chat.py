"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures that render a conversation and note which spans lie inside {% generation %}. A template can read only the loop
variable's fields and use the listed filters: no attribute access, calls, imports or evaluation.

    {% for m in messages %} ... {% if m.role == "user" %} ... {% else %} ... {% endif %}
    {% generation %}{{ m.text | escape }}{% endgeneration %} {{ "a" + "b" }} {% endfor %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, table

#: Control strings that a text must not contain unescaped; the first two mark turns in TEMPLATE.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    '{% for m in messages %}{{ "<|turn|>" + "" }}{{ m.role | header }}\n{% if m.role == "assistant" %}'
    '{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ "<|end|>" + "\\n" }}{% endfor %}'
)
_ESCAPED = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))


def escape(text: str) -> str:
    """Reversible: a backslash goes before each backslash and after the first character of each control string."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def header(text: str) -> str:
    """escape() for one line: line feeds become backslash and n, which no control string has second."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S)


def unheader(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": header, "trim": str.strip, "upper": str.upper, "lower": str.lower}


@dataclass
class Output:
    """What a rendering fills: the parts of the text, their length so far, and the generation spans."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


class TemplateError(ValueError):
    """The template isn't in the language."""


# Syntax tree: ("text", s) ("emit", expr) ("for", var, name, body) ("if", [(cond, body)], orelse) ("gen", body);
# expressions: ("const", v) ("field", var, name) ("add", a, b) ("eq"|"ne", a, b) ("not", a) ("and"|"or", a, b) ("filter", a, name).
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(==|!=|[+|()]))')


def _tokens(source: str) -> list[str]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def _expression(tokens: list[str]):
    """Precedence from loose to tight: or, and, not, == and !=, +, |."""

    def peek() -> str:
        return tokens[0] if tokens else ""

    def chain(word: str, below):
        node = below()
        while peek() == word:
            tokens.pop(0)
            node = (word, node, below())
        return node

    def negated():
        if peek() == "not":
            tokens.pop(0)
            return ("not", negated())
        node = added()
        if peek() in ("==", "!="):
            return ("eq" if tokens.pop(0) == "==" else "ne", node, added())
        return node

    def added():
        node = piped()
        while peek() == "+":
            tokens.pop(0)
            node = ("add", node, piped())
        return node

    def piped():
        node = atom()
        while peek() == "|":
            tokens.pop(0)
            if (name := tokens.pop(0) if tokens else "") not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", node, name)
        return node

    def atom():
        token = tokens.pop(0) if tokens else ""
        if token == "(":
            node = chain("or", lambda: chain("and", negated))
            if not tokens or tokens.pop(0) != ")":
                raise TemplateError("a bracket isn't closed")
            return node
        if token[:1] in ("'", '"'):
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
        if re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", token) and "__" not in token:
            return ("field", *token.split("."))
        raise TemplateError(f"{token!r} isn't a value")

    node = chain("or", lambda: chain("and", negated))
    if tokens:
        raise TemplateError(f"{tokens[0]!r} is left over")
    return fold(node)


def fold(node):
    """The expression with its constant parts computed; equal operands of 'add' on the left are grouped by the parser."""
    kind, *parts = node
    parts = [fold(p) if isinstance(p, tuple) else p for p in parts]
    node = (kind, *parts)
    values = [p[1] for p in parts if isinstance(p, tuple) and p[0] == "const"]
    if kind in ("const", "field") or len(values) < sum(isinstance(p, tuple) for p in parts):
        return node
    match kind:
        case "add":
            return ("const", values[0] + values[1])
        case "filter":
            return ("const", FILTERS[parts[1]](values[0]))
        case "eq":
            return ("const", values[0] == values[1])
        case "ne":
            return ("const", values[0] != values[1])
        case "not":
            return ("const", not values[0])
        case "and":
            return ("const", values[0] and values[1])
        case _:
            return ("const", values[0] or values[1])


def parse(template: str) -> list:
    """The syntax tree of a template; TemplateError if a tag is unknown or not closed."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    top: list = []
    stack: list[tuple[str, list, object]] = [("", top, None)]

    def open_block(name: str, body: list, node: object) -> None:
        stack.append((name, body, node))

    for piece in filter(None, pieces):
        body = stack[-1][1]
        if piece.startswith("{{"):
            node = _expression(_tokens(piece[2:-2]))
            body.append(("text", node[1]) if node[0] == "const" else ("emit", node))
        elif piece.startswith("{%"):
            words = piece[2:-2].split(None, 1)
            name, rest = (words + ["", ""])[:2]
            if name == "for" and (m := re.fullmatch(r"(\w+) +in +(\w+)\s*", rest)):
                body.append(node := ("for", m[1], m[2], []))
                open_block("for", node[3], node)
            elif name == "if":
                body.append(node := ("if", [(_expression(_tokens(rest)), [])], []))
                open_block("if", node[1][0][1], node)
            elif name in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[2]
                if name == "elif":
                    node[1].append((_expression(_tokens(rest)), []))
                open_block("if" if name == "elif" else "else", node[1][-1][1] if name == "elif" else node[2], node)
            elif name == "generation":
                body.append(node := ("gen", []))
                open_block("generation", node[1], node)
            elif name.startswith("end") and (stack[-1][0] == name[3:] or stack[-1][0] == "else" and name == "endif"):
                stack.pop()
            else:
                raise TemplateError(f"{piece} doesn't fit here")
        else:
            body.append(("text", piece))
    if len(stack) > 1:
        raise TemplateError(f"{{% {stack[-1][0]} %}} isn't closed")
    return top


def merge_text(nodes: list) -> list:
    """Neighbouring constant texts become one; branches with a constant condition are chosen."""
    flat: list = []
    for node in nodes:
        match node:
            case ("for", var, name, body):
                flat.append(("for", var, name, merge_text(body)))
            case ("gen", body):
                flat.append(("gen", merge_text(body)))
            case ("if", cases, orelse):
                cases = [(c, b) for c, b in cases if c[0] != "const" or c[1]]
                sure = next((i for i, (c, _) in enumerate(cases) if c[0] == "const"), None)
                if sure is not None:
                    cases, orelse = cases[:sure], cases[sure][1]
                if cases:
                    flat.append(("if", [(c, merge_text(b)) for c, b in cases], merge_text(orelse)))
                else:
                    flat += merge_text(orelse)
            case _:
                flat.append(node)
    out: list = []
    for node in flat:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


def _value(node) -> Callable[[dict], object]:
    kind, *parts = node
    if kind == "const":
        return lambda scope, v=parts[0]: v
    if kind == "field":
        return lambda scope, var=parts[0], name=parts[1]: scope[var].get(name) or ""
    if kind == "filter":
        return lambda scope, f=FILTERS[parts[1]], a=_value(parts[0]): f(a(scope))
    if kind == "not":
        return lambda scope, a=_value(parts[0]): not a(scope)
    a, b = map(_value, parts)
    return {
        "add": lambda scope: a(scope) + b(scope),
        "eq": lambda scope: a(scope) == b(scope),
        "ne": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
    }[kind]


def _block(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable[[dict, Output], None]:
    match node:
        case ("text", text):
            return lambda scope, out: out.put(text)
        case ("emit", expression):
            value = _value(expression)
            return lambda scope, out: out.put(value(scope))
        case ("for", var, name, body):
            inner = _block(body)

            def loop(scope: dict, out: Output) -> None:
                for item in scope[name]:
                    inner({**scope, var: item}, out)

            return loop
        case ("if", cases, orelse):
            tests, last = [(_value(c), _block(b)) for c, b in cases], _block(orelse)

            def choose(scope: dict, out: Output) -> None:
                next((b for c, b in tests if c(scope)), last)(scope, out)

            return choose
        case ("gen", body):
            inner = _block(body)

            def generation(scope: dict, out: Output) -> None:
                start = out.length
                inner(scope, out)
                out.spans.append((start, out.length))

            return generation
    raise TemplateError(f"unknown node {node[0]}")


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts with role and text) to the text and its generation spans, in code points."""
    run = _block(merge_text(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans) for each conversation, turns in order of (turn, role, text).

    Null roles and texts count as empty, null turns come first, repeated rows are separate turns; each row with a null
    conv_id is a conversation of its own, so that lost ids never meet in one row. A conversation is one row of the output,
    so its turns meet in one row here too.
    """
    arrow_limits(turns.sparkSession)
    compile_template(template)  # errors show on the driver
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list("m")).alias("messages")).select("conv_id", "messages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            done = [render(x) for x in batch.column("messages").to_pylist()]
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

    return rows.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, stop: long>>")


def read_back(formatted: str, spans: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) and the texts under the loss mask of a text that TEMPLATE rendered."""
    turns = []
    for part in formatted.split(CONTROLS[0])[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unheader(role), unescape(rest[: rest.rindex(CONTROLS[1])])))
    return turns, [unescape(formatted[s["start"] : s["stop"]]) for s in spans]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from the formatted text and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns, loss = read_back(row["formatted"], row["spans"])
                said, under = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss)
                rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(under), "loss_sha256": hashlib.sha256(under.encode()).hexdigest(), "formatted_chars": len(row["formatted"])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_chats(turns.unionByName(extra)))


def _sql_escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


SQL = f"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, NULL, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        CAST(sum(length(replace({_sql_escaped("role")}, chr(10), '\\n')) + length({_sql_escaped("text")}) + {len(CONTROLS[0]) + len(CONTROLS[1]) + 2}) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""
