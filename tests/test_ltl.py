"""Formulas without Spark: parser, printers, rewrites, decisions, distance, English."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ltlspark import goldens
from ltlspark.ltl import decide, generate, itl, rewrite, treedist
from ltlspark.ltl.ast import BINARY, UNARY, atoms, depth, from_arena, operators, to_arena, walk
from ltlspark.ltl.parse import LATEX, ParseError, parse, show
from ltlspark.schema import GOLDEN

leaves = st.sampled_from(["p", "q", "true", "false"]).map(lambda a: ("atom", a))
trees = st.recursive(leaves, lambda c: st.one_of(st.tuples(st.sampled_from(UNARY), c), st.tuples(st.sampled_from(BINARY), c, c)), max_leaves=6)
fast = settings(max_examples=80, deadline=None)


@fast
@given(trees)
def test_round_trips(f):
    assert from_arena(to_arena(f)) == f
    assert rewrite.flatten(parse(show(f))) == rewrite.flatten(f)
    assert rewrite.flatten(parse(show(f, LATEX), "latex")) == rewrite.flatten(f)


@fast
@given(trees)
def test_rewrites_keep_the_meaning(f):
    for g in (rewrite.nnf(f), rewrite.expand(f), rewrite.flatten(f), rewrite.distribute(f), rewrite.sort_operands(f), rewrite.simplify(f)):
        assert decide.equivalent(f, g) in (True, None)
    assert rewrite.simplify(rewrite.simplify(f)) == rewrite.simplify(f)
    assert all(n[0] != "not" or n[1][0] == "atom" for n in walk(rewrite.nnf(f)))


@fast
@given(trees, trees)
def test_tableau_agrees_with_words(f, g):
    same = decide.equivalent(f, g)
    assert same == decide.equivalent(g, f)
    agree = all(decide.holds(f, w, k) == decide.holds(g, w, k) for w, k in decide.words(["p", "q"], 100))
    assert same is None or not same or agree


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("G(p)", "!F(!p)", True), ("p W q", "(p U q) | G(p)", True), ("p M q", "q U (p & q)", True), ("F(G(p))", "G(F(p))", False), ("G(p | q)", "G(p) | G(q)", False), ("X(p U q)", "X(p) U X(q)", True)],
)
def test_laws(a, b, same):
    assert decide.equivalent(parse(a), parse(b)) is same


def test_budget_gives_no_answer():
    f = parse("G(F(p) & F(q)) & F(G(r U s)) & G(t U u)")
    assert decide.satisfiable(f, states=2) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("G {p} \\land F {q}", "G(p) & F(q)"),
        ("\\left(p \\land q\\right) U r", "(p & q) U r"),
        ("G {p \\land q}", "G(p & q)"),
        ("p \\land q \\land r", "p & q & r"),
        ("\\neg {\\neg {p}}", "!!p"),
        ("p M q", "p M q"),
        ("notify", "notify"),
        ("G(p → Fq)", "G(p -> F(q))"),
        ("(p U q) U r", "(p U q) U r"),
        ("p U (q U r)", "p U (q U r)"),
        ("F G ((p \\lor q) \\land (r -> s))", "F(G((p | q) & (r -> s)))"),
        ("u \\land \\neg {G {\\neg {\\neg {w \\leftrightarrow s}}} U u} \\lor s", "(u & !(G(!!(w <-> s)) U u)) | s"),
    ],
)
def test_notations(text, want):
    assert show(parse(text, "latex")) == want


def test_dialects_differ_in_strength():
    assert show(parse("p U q & r")) == "(p U q) & r"
    assert show(parse("p U q & r", "latex")) == "p U (q & r)"


@pytest.mark.parametrize("bad", ["", "p &", "(p", "p q", "->", "p ) q", None, "p @ q"])
def test_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_published_keys_and_hashes():
    f = rewrite.compat_canonical(parse("G(p -> F q)"))
    assert rewrite.compat_key(f) == "G(\\lor(F(q)\\neg(p)))"
    assert rewrite.canonical_hash(parse("G(p -> F q)"), True) == "7b7f89f31c2f7eae79e7e4c0947d3581968008ccd76b5175493fee47582409e5"
    assert rewrite.canonical_hash(parse("p U q"), True) == rewrite.canonical_hash(parse("q U p"), True) == "6cd8d65250cc038962c0c1ea7b11882c5ec5273218e79024c3a63bf57d6d868b"
    assert rewrite.canonical_hash(parse("p U q")) != rewrite.canonical_hash(parse("q U p"))
    assert rewrite.canonical_hash(parse("q & p"), True) == "cd727a99cdfbee8ee04b602d68a13787023694f0b51bf69f9e2454df42ef3bdd"
    assert rewrite.compat_rejects(parse("p & (q & r)")) and not rewrite.compat_rejects(parse("p & q"))


def test_measures():
    f = parse("G(p -> F(q & true))")
    assert (depth(f), operators(f), atoms(f)) == (4, 4, ["p", "q"])


def test_golden_english():
    for formula, text, _ in GOLDEN:
        f = parse(formula)
        assert itl.render(f) == text
        assert decide.equivalent(itl.parse_itl(itl.render(f, grouped=True)), f) is True
    assert itl.render(parse("p & q & r")) == "p and q and r"


@pytest.mark.parametrize(
    ("text", "compat", "fixed"),
    [
        ("Always, if p, then Eventually, q", "G((p) -> (F(q)))", "G((p) -> (F(q)))"),
        ("p weakly until q", "(p) U (q)", "(p) W (q)"),
        ("not p and q", "!((p) & (q))", "!((p) & (q))"),
        ("p releases q", "(p) R (q)", "(p) R (q)"),
        ("p strong release q", "p", "(p) M (q)"),
        ("notify", "!(ify)", "notify"),
    ],
)
def test_english_both_ways(text, compat, fixed):
    assert itl.operand_text(itl.parse_itl(text, compat=True)) == compat
    assert itl.operand_text(itl.parse_itl(text)) == fixed


def test_tree_distance():
    assert treedist.distance(parse("G(p -> F q)"), parse("G(p -> q)")) == 1
    assert treedist.distance(parse("p U q"), parse("q U p")) == 2
    assert treedist.normalised(parse("p"), parse("p")) == 0


@fast
@given(trees, trees, trees)
def test_tree_distance_is_a_metric(f, g, h):
    d = treedist.distance
    assert d(f, f) == 0 and d(f, g) == d(g, f) and d(f, h) <= d(f, g) + d(g, h)


def test_generator_depends_on_seed_and_number_alone():
    made = [generate.formula(1, k, 4) for k in range(50)]
    assert made == [generate.formula(1, k, 4) for k in range(50)] and len(set(made)) > 20
    assert all(depth(f) <= 4 for f in made) and made != [generate.formula(2, k, 4) for k in range(50)]
    assert [generate.space_size(k) for k in (1, 2, 3)] == [8, 176, 69696]


@pytest.mark.parametrize(("text", "key", "compat"), goldens.KEYS)
def test_keys_are_as_written_down(text, key, compat):
    assert (rewrite.key(parse(text)), rewrite.compat_key(parse(text))) == (key, compat)


@pytest.mark.parametrize(("text", "normal", "compat"), goldens.NORMAL)
def test_hashes_are_of_the_normal_forms_written_down(text, normal, compat):
    f = parse(text)
    assert rewrite.canonical_hash(f) == hashlib.sha256(normal.encode()).hexdigest()
    assert rewrite.canonical_hash(f, True) == hashlib.sha256(compat.encode()).hexdigest()


@pytest.mark.parametrize(("text", "latex", "said", "nnf", "_"), goldens.TEXTS)
def test_texts_mean_the_formula(text, latex, said, nnf, _):
    f = parse(text)
    assert itl.render(f) == said and decide.equivalent(f, parse(nnf)) is True


@pytest.mark.parametrize(("said", "back"), goldens.BACK)
def test_english_reads_back_as_written_down(said, back):
    assert itl.operand_text(itl.parse_itl(said)) == back


@pytest.mark.parametrize(("a", "b", "edits", "nodes"), goldens.DISTANCES[:-1])
def test_distances_are_as_written_down(a, b, edits, nodes):
    f, g = parse(a), parse(b)
    assert treedist.distance(f, g) == treedist.distance(g, f) == edits and max(sum(1 for _ in walk(x)) for x in (f, g)) == nodes
