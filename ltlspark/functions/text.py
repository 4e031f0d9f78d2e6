"""Text and JSON functions as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ltl.itl import FILLERS
from ..schema import DOMAINS

WHITE = " \t\n\r\f\v"
# Phrases that mark a verdict's text.
POSITIVE = [r"\bcorrect\b.*\btranslation\b", r"\baccurately\s+capture", r"\btrue\s+to\s+the\s+formula\b"]
NEGATIVE = [r"\bincorrect\b.*\btranslation\b", r"\bdoes\s+not\s+preserve\b", r"\bmisrepresents\b", r"\bnot\s+equivalent\b"]
DEFAULT_ISSUE = "Temporal relationship not preserved"
FAILED = "[Generation failed]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def word_count(c: Column) -> Column:
    s = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("long")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tag(c: Column, name: str) -> Column:
    """The first <name>...</name>, stripped; null without one."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def normalise_domain(c: Column, domains: list[str] = DOMAINS) -> Column:
    """The first domain that contains the text or is contained in it, whatever the case; else the first."""

    def fitting(low: Column) -> Column:
        fits = F.filter(F.array(*map(F.lit, domains)), lambda d: F.contains(F.lower(d), low) | F.contains(low, F.lower(d)))
        return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(domains[0]))

    return F.when(c.isNotNull(), let(F.lower(strip(c)), fitting))


def response(c: Column) -> Column:
    """struct(domain, activity, translation) of a tagged reply; null unless all three are there and not empty."""
    d, a, t = (F.nullif(strip(F.regexp_extract(c, f"(?s)<{n}>(.*?)</{n}>", 1)), F.lit("")) for n in ("domain", "activity", "translation"))
    return F.when(d.isNotNull() & a.isNotNull() & t.isNotNull(), F.struct(normalise_domain(d).alias("domain"), a.alias("activity"), t.alias("translation")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


VERDICT = "is_correct boolean, score int, issues array<string>, reasoning string"


def judge_parse(c: Column) -> Column:
    """struct(is_correct, score, issues, reasoning, source) of a model's reply.

    JSON between the outermost braces, if it is JSON; else the fields by pattern, and
    verdict phrases where there is no field (a negative one wins). A JSON reply
    without is_correct is taken as false; a score outside 0..10 becomes null.
    """
    clean = strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(c.isNotNull(), let(clean, _from_clean))


def _limited(score: Column) -> Column:
    return F.when(score.between(0, 10), score)


def _from_clean(clean: Column) -> Column:
    def read(body: Column) -> Column:
        made = F.when(body != "", F.from_json(body, f"{VERDICT}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
        return let(made, lambda m: F.when(m.isNotNull() & m["broken"].isNull(), _from_json(m)).otherwise(_from_text(clean)))

    return let(F.regexp_extract(clean, r"(?s)(\{.*\})", 1), read)


def _from_json(made: Column) -> Column:
    issues = F.coalesce(made["issues"], F.array().cast("array<string>"))
    return F.struct(F.coalesce(made["is_correct"], F.lit(False)).alias("is_correct"), _limited(made["score"]).alias("score"), issues.alias("issues"), made["reasoning"].alias("reasoning"), F.lit("json").alias("source"))


def _from_text(clean: Column) -> Column:
    found = lambda ps: clean.rlike("(?i)" + "|".join(ps))
    field = lambda pattern, then: let(F.regexp_extract(clean, pattern, 1), then)

    def issues(inside: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(inside, F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.btrim(x, F.lit(" \"'")))
        plain = F.filter(F.transform(F.split(inside, ","), strip), lambda x: x != "")
        return let(quoted, lambda q: F.when(F.size(q) > 0, q).otherwise(plain))

    def told(verdict: Column) -> Column:
        score = field('(?i)score[": ]*(\\d+)', lambda d: F.when(d != "", d.try_cast("int")).otherwise(F.when(verdict, 8).otherwise(3)))
        listed = let(field(r'(?s)issues[": ]*\[(.*?)\]', issues), lambda x: F.when((F.size(x) == 0) & ~verdict, F.array(F.lit(DEFAULT_ISSUE))).otherwise(x))
        return F.struct(verdict.alias("is_correct"), let(score, _limited).alias("score"), listed.alias("issues"), clean.alias("reasoning"), F.lit("text").alias("source"))

    verdict = field('(?i)is_correct[": ]*(true|false)', lambda said: F.when(said != "", F.lower(said) == "true").otherwise(found(POSITIVE) & ~found(NEGATIVE)))
    return let(verdict, told)


def clean_atom(c: Column) -> Column:
    """A proposition's text without filler phrases; its first one-letter word in lower case, if it has one."""
    text = F.regexp_replace(c, f"(?i){FILLERS}", "")
    low = F.lower(text)
    short = F.btrim(text, F.lit(" ,.;:"))
    one = F.try_element_at(F.filter(F.split(short, r"\s+"), lambda w: w.rlike(r"^[a-z]$")), F.lit(1))
    return F.when(low.isin("true", "truth", "is always satisfied"), "true").when(low.isin("false", "falsehood", "is never satisfied"), "false").otherwise(F.coalesce(one, short))


def balanced(c: Column) -> Column:
    """Whether every parenthesis has its partner, in order."""
    signs = F.filter(F.split(F.regexp_replace(c, "[^()]", ""), ""), lambda x: x != "")
    level = F.aggregate(signs, F.lit(0), lambda n, x: F.when(n < 0, n).when(x == "(", n + 1).otherwise(n - 1))
    return level == 0


def basic_conversion(c: Column) -> Column:
    """LaTeX to ASCII by replacement alone: braces go, scope with them; null where they are not balanced."""
    out = c
    for a, b in (("\\land", "&"), ("\\lor", "|"), ("\\neg", "!"), ("\\rightarrow", "->"), ("\\leftrightarrow", "<->"), ("\\left(", "("), ("\\right)", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    even = F.length(F.replace(c, F.lit("{"), F.lit(""))) == F.length(F.replace(c, F.lit("}"), F.lit("")))
    return F.when(even, strip(F.regexp_replace(F.translate(out, "{}", ""), r"\s+", " ")))


def repair_operators(c: Column) -> Column:
    """G|( and the like become G(."""
    return F.when(c.rlike(r"[A-Z]\s*\|\s*\("), F.regexp_replace(c, r"([GFXURWM])\s*\|\s*\(", "$1(")).otherwise(c)


def replace_first(c: Column, phrase: str, by: Column) -> Column:
    """by is taken as it is, but for $ and backslashes."""
    return F.regexp_replace(c, F.lit(f"(?s)^(.*?){re.escape(phrase)}"), F.concat(F.lit("$1"), by))


def duration(seconds: Column) -> Column:
    """1h 2m 3s."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("__"))


def mask_tokens(ids: Column, pad: int, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == ignore, pad).otherwise(x))


# Sentences by a formula's pattern class. {p} and {q} are its operands (response: those of the implication;
# reactivity and stability: the operand's operand; precedence: {p} without its negation).
STRUCTURED = {
    "response": ["Whenever {p} occurs, {q} will eventually follow", "Each time {p} happens, {q} will happen at some point afterward", "If {p} ever becomes true, then {q} must become true later"],
    "precedence": ["{p} cannot occur before {q}", "{p} must be preceded by {q}", "Either {q} happens first, or {p} never happens"],
    "invariance": ["At all times, {p} holds", "It is invariably the case that {p}", "{p} is true in every state"],
    "eventuality": ["At some point, {p} will become true", "Eventually, {p} will hold", "In the future, {p} will be satisfied"],
    "until": ["{p} holds until {q} becomes true", "{p} continues to be true until {q} occurs", "{p} remains valid until a point where {q} is satisfied"],
    "release": ["{p} releases {q} from having to hold", "{q} holds until and including the moment {p} holds", "{q} must remain true until {p} becomes true, or forever if {p} never holds"],
    "reactivity": ["{p} will occur infinitely often", "It is always the case that {p} will eventually happen", "At every point, {p} will occur sometime in the future"],
    "stability": ["Eventually, {p} will hold forever", "At some point, {p} becomes permanently true", "There will be a time after which {p} is always satisfied"],
}

# What a paraphrase puts in a phrase's place.
SIMPLE = [("Always,", "At all times,"), ("Always,", "Invariably,"), ("Eventually,", "At some point,"), ("Eventually,", "In the future,"), ("until", "holds until")]
ADDITIONAL = [("Always,", "It is always the case that"), ("Always,", "In every state,"), ("Eventually,", "There will be a time when"), ("Eventually,", "Ultimately,"), ("In the next state,", "Immediately after this,")]
REPHRASE = {
    "Always,": ["At all times,", "It is invariably the case that", "Invariably,"],
    "Eventually,": ["At some point,", "At some time in the future,", "Ultimately,"],
    "In the next state,": ["In the immediately following state,", "Next,"],
    "until": ["holds until", "is true until", "continues until"],
    "releases": ["frees", "releases the obligation that"],
    "weakly until": ["unless", "either holds forever or until"],
    "and": ["as well as", "together with", "along with"],
    "or": ["alternatively", "otherwise"],
    "not": ["it is not the case that", "it is false that"],
}


def filled(template: str, **places: Column) -> Column:
    """A template's text with columns in its {places}."""
    return F.concat(*[places[part] if k % 2 else F.lit(part) for k, part in enumerate(re.split(r"\{(\w+)\}", template)) if part])


def variations(c: Column, additional: bool = False) -> Column:
    """Distinct paraphrases by phrase replacement, those that apply."""
    made = [F.when(F.contains(c, F.lit(a)), F.replace(c, F.lit(a), F.lit(b))) for a, b in SIMPLE + (ADDITIONAL if additional else [])]
    return F.array_distinct(F.array_compact(F.array(*made)))


def rephrase(c: Column) -> Column:
    """Each phrase's first occurrence replaced by an alternative that the md5 of text and phrase picks."""
    out = c
    for phrase, others in REPHRASE.items():
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat(c, F.lit(phrase))), 1, 8), 16, 10).cast("long"), F.lit(len(others)))
        out = replace_first(out, phrase, F.element_at(F.array(*map(F.lit, others)), (pick + 1).cast("int")))
    return out


