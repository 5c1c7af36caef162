"""Text functions: trimming, words, templates, and the parsing of completions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and word splitting go by.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# The same characters as a list, for what trims by characters and so looks at a text's edges only.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Anything else.  Letters are told by one range, not by a test for each kind of space.
_DARK = rf"(?:[!-~]|[^{SPACE[1:-1]}])"

# What is taken off a line to get at its candidate, one after another.
# Repeats are possessive, and a run at the end is tried from its first place only, so
# that a pattern takes time in proportion to the text whatever runs it holds.
CANDIDATE_EDGES = (
    rf"^```[A-Za-z]*+{SPACE}*+",
    r"```\z",
    rf"^{SPACE}*+(?:[-*]|\d++[).\]:-]){SPACE}*+",
    rf"(?i)^candidate{SPACE}*+(?:\d++{SPACE}*+)?[:.-]{SPACE}*+",
    r"""^["'`]++|(?<!["'`])["'`]++\z""",
    r"^<|>\z",
)

# Fixed value: a template written as an assignment.
_TEMPLATE = rf"""(?s)^{SPACE}*+[A-Za-z_][A-Za-z0-9_]*+{SPACE}*+={SPACE}*+(["']{{3}})(.*?)\1{SPACE}*+\z"""


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    """Whether a text is missing or has nothing but white space; decided at its first other character."""
    return ~F.coalesce(F.rlike(text, F.lit(_DARK)), F.lit(False))


def words(text: Column) -> Column:
    """The runs of other characters; every space is first made a plain one, for splitting at a single character needs no pattern."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_DARK}++"))


def lower_fold(text: Column) -> Column:
    return F.lower(text)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def strip_fences(text: Column) -> Column:
    """Without code fences, wherever they stand."""
    return js_trim(F.replace(F.regexp_replace(text, r"```[A-Za-z]*\n?", ""), F.lit("```"), F.lit("")))


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def normalize_candidate(line: Column) -> Column:
    out = js_trim(line)
    for edge in CANDIDATE_EDGES:
        out = F.regexp_replace(out, edge, "")
    return js_trim(out)


def parse_candidates(raw: Column, most: int | Column | None = None) -> Column:
    """The candidates of a completion, in order: all, or the first ``most``, cut here before anything is exploded or embedded."""
    found = F.filter(F.transform(split_lines(strip_fences(raw)), normalize_candidate), lambda c: c != "")
    return found if most is None else F.slice(found, 1, most)


def template_body(template: Column) -> Column:
    """What stands between the quotes of ``NAME = \"\"\"...\"\"\"``, or else the whole text; trimmed."""
    return js_trim(F.when(F.rlike(template, F.lit(_TEMPLATE)), F.regexp_extract(template, _TEMPLATE, 2)).otherwise(template))


def render_template(template: Column, variables: Column) -> Column:
    """Known ``{names}`` replaced in one pass: values are not looked at again, unknown names stay."""
    parts = F.regexp_extract_all(template_body(template), F.lit(r"(\{[A-Za-z0-9_]+\}|[^{]+|\{)"), F.lit(1))
    name = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    known = lambda p: F.rlike(p, F.lit(r"^\{[A-Za-z0-9_]+\}\z")) & F.map_contains_key(variables, name(p))
    return F.array_join(F.transform(parts, lambda p: F.when(known(p), F.element_at(variables, name(p))).otherwise(p)), "")


def render_fixed(template: str, variables: dict[str, Column]) -> Column:
    """What ``render_template`` gives, of a template that is known with the plan: its names are looked for once and not in each row."""
    whole = re.match(_TEMPLATE.replace(r"\z", r"\Z"), template)
    parts = re.findall(r"\{[A-Za-z0-9_]+\}|[^{]+|\{", (whole[2] if whole else template).strip(SPACES))
    known = lambda p: p[0] == "{" and p[1:-1] in variables
    return F.concat(F.lit(""), *(F.coalesce(variables[p[1:-1]], F.lit("")) if known(p) else F.lit(p) for p in parts))


def movement_id(number: Column) -> Column:
    """``mov-`` and the number, of four digits at least."""
    return F.format_string("mov-%04d", number)


# What the result tables call operators and states.
def operator_label(operator: Column, source: Column) -> Column:
    return F.when(operator == "turbulence", "turbulencia").when(source == "pbest", "pbest").otherwise("líder/gbest")


def status_label(error: Column, applied: Column, otherwise: Column) -> Column:
    """The error; else ``aplicado`` where applied; else the other text, or ``ok``."""
    return F.coalesce(error, F.when(applied, F.lit("aplicado")), otherwise, F.lit("ok"))


def uniform_draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and parts alone, whatever the partitioning or retry."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
