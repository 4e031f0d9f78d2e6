"""Folds over the columnar tree as Catalyst expressions: no Python at run time.

`aggregate` walks the post-order array with an array as evaluation stack: a node
takes its arity of values off the end and puts its own on. A null array gives null,
and so does one that does not leave one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ltl.ast import NARY
from ..ltl.itl import TEMPLATES
from ..ltl.parse import LATEX, SPOT
from .text import let


def fold(ast: str, node: str, kind: str = "string") -> Column:
    """ast names the column; node is SQL over n (k, a, v) and x, the array of its operands' values of type kind."""
    keep = "greatest(size(st) - n.a, 0)"
    one = f"transform(array(slice(st, {keep} + 1, n.a)), x -> {node})[0]"
    return F.expr(f"aggregate({ast}, cast(array() as array<{kind}>), (st, n) -> concat(slice(st, 1, {keep}), array(cast({one} as {kind}))), st -> case when size(st) = 1 then st[0] end)")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def _cases(texts: dict[str, str]) -> str:
    return "case n.k when 'atom' then n.v " + " ".join(f"when '{k}' then {v}" for k, v in texts.items()) + " end"


def _filled(template: str) -> str:
    """concat(...) of a template with {0} and {1}."""
    parts = template.replace("{0}", "\0{0}\0").replace("{1}", "\0{1}\0").split("\0")
    return "concat(" + ", ".join(f"get(x, {p[1]})" if p in ("{0}", "{1}") else _quoted(p) for p in parts if p) + ")"


def itl_render(ast: str) -> Column:
    """Canonical controlled English; and/or join any number of operands."""
    return fold(ast, _cases({k: f"array_join(x, ' {k} ')" if k in NARY else _filled(t) for k, t in TEMPLATES.items()}))


def ltl_render(ast: str, latex: bool = False) -> Column:
    """Formula text with every operand that has operands in parentheses (braces around unary operands in LaTeX)."""
    signs = LATEX if latex else SPOT
    before, after = (" {", "}") if latex else ("(", ")")
    unary = lambda s: f"concat({_quoted(s + before)}, get(x, 0), '{after}')"
    side = lambda i: f"case when get(x, {i}) rlike '^[A-Za-z0-9_]+$' then get(x, {i}) else concat('(', get(x, {i}), ')') end"
    own = {}
    for k, s in signs.items():
        if k in ("not", "next", "always", "eventually"):
            own[k] = unary(s)
        elif k in NARY:
            own[k] = f"array_join(transform(x, y -> case when y rlike '^[A-Za-z0-9_]+$' then y else concat('(', y, ')') end), {_quoted(' ' + s + ' ')})"
        else:
            own[k] = f"concat({side(0)}, {_quoted(' ' + s + ' ')}, {side(1)})"
    return fold(ast, _cases(own))


# How loosely operators bind when a formula is printed as published.
RANKS = {"not": 1, "and": 2, "or": 3, "implies": 4, "iff": 5}


def ltl_published(ast: str) -> Column:
    """LaTeX as published: unary operands in braces, a binary operator's operand in brackets if it binds more loosely.

    Temporal operators rank below all others, so they never get brackets and give them to every other operator.
    """
    said = {}
    for k, s in LATEX.items():
        own = RANKS.get(k, 0)
        if k in ("not", "next", "always", "eventually"):
            said[k] = f"concat({_quoted(s + ' {')}, get(x, 0).t, '}}')"
        else:
            said[k] = f"array_join(transform(x, y -> case when y.r > {own} then concat({_quoted(chr(92) + 'left(')}, y.t, {_quoted(chr(92) + 'right)')}) else y.t end), {_quoted(' ' + s + ' ')})"
    rank = "case n.k " + " ".join(f"when '{k}' then {r}" for k, r in RANKS.items()) + " else 0 end"
    return fold(ast, f"named_struct('t', {_cases(said)}, 'r', {rank})", "struct<t:string,r:int>").getField("t")


def ltl_key(ast: str, compat: bool = False) -> Column:
    """Prefix key: operands of commutative operators sorted; compat sorts those of every operator and has no separators."""
    own = {}
    for k, s in LATEX.items():
        args = "array_sort(x)" if compat or k in ("and", "or", "iff") else "x"
        own[k] = f"concat({_quoted(s + '(')}, array_join({args}, {_quoted('' if compat else ',')}), ')')"
    return fold(ast, _cases(own))


def tree_depth(ast: str) -> Column:
    return fold(ast, "case when n.a = 0 then 0 else 1 + array_max(x) end", "int")


def operator_count(ast: str) -> Column:
    return F.expr(f"size(filter({ast}, n -> n.a > 0))").cast("int")


def atoms(ast: str) -> Column:
    """Distinct propositions, sorted."""
    return F.expr(f"array_sort(array_distinct(transform(filter({ast}, n -> n.a = 0 and n.v not in ('true', 'false')), n -> n.v)))")


def proposition_count(ast: str) -> Column:
    return F.size(atoms(ast)).cast("int")


def _shape(ast: str) -> Column:
    """Kinds of the top two levels, and of the last operand's operand: 'always(implies(atom,eventually))'."""
    return fold(ast, "case when n.a = 0 then n.k else concat(n.k, '(', array_join(x, ','), ')') end")


def classify(ast: str, compat: bool = False) -> Column:
    """Pattern class by the root's and its operands' kinds; compat tests invariance and eventuality first, which hides reactivity and stability."""
    general = [("^always\\(", "invariance"), ("^eventually\\(", "eventuality")]
    special = [("^always\\(eventually\\(", "reactivity"), ("^eventually\\(always\\(", "stability")]
    tests = [("^weak_until\\(not\\(", "precedence"), *(general if compat else special + general), ("^until\\(", "until"), ("^release\\(", "release")]

    def named(shape: Column) -> Column:
        out = F
        for pattern, name in tests:
            out = out.when(shape.rlike(pattern), name)
        return out.otherwise(F.when(shape.isNotNull(), "general"))

    return F.when(_last_is_eventually(ast), "response").otherwise(let(_shape(ast), named))


def _last_is_eventually(ast: str) -> Column:
    """In post-order the last operand's root is the node before its parent: root always, implies, eventually."""
    return F.expr(f"try_element_at({ast}, -1).k = 'always' and try_element_at({ast}, -2).k = 'implies' and try_element_at({ast}, -3).k = 'eventually'")


def sexpr(ast: str) -> Column:
    """kind(operand, ...) for unary and (left kind right) for binary nodes, as the trees print themselves."""
    return fold(ast, "case when n.a = 0 then n.v when n.a = 1 then concat(n.k, '(', get(x, 0), ')') else concat('(', array_join(x, concat(' ', n.k, ' ')), ')') end")


def operands(ast: str) -> Column:
    """Texts of the root's operands, as the trees print themselves; none for an atom."""
    said = "case when n.a = 0 then n.v when n.a = 1 then concat(n.k, '(', get(x, 0).said, ')') else concat('(', array_join(transform(x, y -> y.said), concat(' ', n.k, ' ')), ')') end"
    node = f"named_struct('said', {said}, 'parts', transform(x, y -> y.said))"
    return fold(ast, node, "struct<said:string,parts:array<string>>").getField("parts")


def proposition(ast: str, role: str) -> Column:
    """A part of a formula by its role: condition (of a unary root), left, right, antecedent, consequent; else 'the condition'.

    antecedent and consequent are those of an implication under always; a consequent's own eventually is left out.
    """
    parts = operands(ast)
    size = F.size(parts)
    kind = F.expr(f"try_element_at({ast}, -1).k")
    if role == "condition":
        found = F.when(size == 1, F.get(parts, F.lit(0)))
    elif role in ("left", "right"):
        found = F.when(size == 2, F.get(parts, F.lit(int(role == "right"))))
    elif role in ("antecedent", "consequent"):
        inner = _operands_below(ast)
        text = F.get(inner, F.lit(int(role == "consequent")))
        if role == "consequent":
            text = F.when(_last_is_eventually(ast), F.regexp_extract(text, r"(?s)^eventually\((.*)\)$", 1)).otherwise(text)
        found = F.when((kind == "always") & (F.expr(f"try_element_at({ast}, -2).k") == "implies"), text)
    else:
        found = F.lit(None).cast("string")
    return F.when(kind.isNotNull(), F.coalesce(found, F.lit("the condition")))


def _operands_below(ast: str) -> Column:
    """The operands of a unary root's operand: those of the array without its last node."""
    return operands(f"slice({ast}, 1, greatest(size({ast}) - 1, 0))")


def to_json(ast: str) -> Column:
    """Nested JSON of type, value and children."""
    value = "case when n.v is null then 'null' else concat('\"', n.v, '\"') end"
    return fold(ast, f"concat('{{\"type\":\"', n.k, '\",\"value\":', {value}, ',\"children\":[', array_join(x, ','), ']}}')")


def paren_depth(text: Column) -> Column:
    """How many opening parentheses a text has."""
    return (F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))).cast("int")


def nnf_text(ast: str) -> Column:
    """Negation normal form as text, in one fold: each value is the pair of the formula's and its negation's text."""
    p, q = (lambda i: f"get(x, {i}).p"), (lambda i: f"get(x, {i}).q")
    pair = lambda a, b: f"named_struct('p', {a}, 'q', {b})"
    two = lambda s, a, b: f"concat('(', {a}, ' {s} ', {b}, ')')"
    many = lambda s, side: f"concat('(', array_join(transform(x, y -> y.{side}), ' {s} '), ')')"
    one = lambda s, a: f"concat('{s}(', {a}, ')')"
    own = {
        "not": pair(q(0), p(0)),
        "and": pair(many("&", "p"), many("|", "q")),
        "or": pair(many("|", "p"), many("&", "q")),
        "implies": pair(two("|", q(0), p(1)), two("&", p(0), q(1))),
        "iff": pair(two("&", two("|", q(0), p(1)), two("|", q(1), p(0))), two("|", two("&", p(0), q(1)), two("&", p(1), q(0)))),
        "always": pair(one("G", p(0)), one("F", q(0))),
        "eventually": pair(one("F", p(0)), one("G", q(0))),
        "next": pair(one("X", p(0)), one("X", q(0))),
        "until": pair(two("U", p(0), p(1)), two("R", q(0), q(1))),
        "release": pair(two("R", p(0), p(1)), two("U", q(0), q(1))),
        "weak_until": pair(two("R", p(1), two("|", p(0), p(1))), two("U", q(1), two("&", q(0), q(1)))),
        "strong_release": pair(two("U", p(1), two("&", p(0), p(1))), two("R", q(1), two("|", q(0), q(1)))),
    }
    leaf = "case n.v when 'true' then " + pair("'true'", "'false'") + " when 'false' then " + pair("'false'", "'true'") + " else " + pair("n.v", "concat('!', n.v)") + " end"
    node = "case n.k when 'atom' then " + leaf + " " + " ".join(f"when '{k}' then {v}" for k, v in own.items()) + " end"
    return fold(ast, node, "struct<p:string,q:string>").getField("p")
