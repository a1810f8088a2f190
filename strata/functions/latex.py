"""Plain text of LaTeX formulas and fuzzy phrases: Arrow UDFs, since balanced braces and sequence matching are no regular languages."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import fix_glyphs


def _greek() -> dict[str, str]:
    """Greek letters by their Unicode names: lower-case ones, capitals that differ from Latin ones, and variant forms."""
    small = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
    large = "gamma delta theta lamda xi pi sigma upsilon phi psi omega".split()
    name = lambda x: x.replace("lamda", "lambda")
    out = {name(x): unicodedata.lookup(f"GREEK SMALL LETTER {x}") for x in small}
    out |= {name(x).capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {x}") for x in large}
    return out | {f"var{x}": out[x] for x in ("epsilon", "theta", "pi", "phi")}


#: Commands that stand for a symbol, and operator names that stay as they are.
SYMBOLS = {
    "times": "×", "div": "÷", "cdot": "·", "cdots": "…", "ldots": "…", "dots": "…", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "leqq": "≤",
    "ge": "≥", "geq": "≥", "geqq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "propto": "∝", "infty": "∞",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "leftrightarrow": "↔", "Leftrightarrow": "⇔",
    "implies": "⇒", "iff": "⇔", "mapsto": "↦", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "cup": "∪", "cap": "∩",
    "emptyset": "∅", "varnothing": "∅", "forall": "∀", "exists": "∃", "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "partial": "∂",
    "nabla": "∇", "angle": "∠", "perp": "⊥", "parallel": "∥", "circ": "∘", "degree": "°", "prime": "′", "ast": "*", "star": "⋆", "surd": "√",
    "lt": "<", "gt": ">", "mid": "|", "vert": "|", "Vert": "‖", "because": "∵", "therefore": "∴", "not": "¬", "neg": "¬", "land": "∧",
    "lor": "∨", "colon": ":",
}
#: Commands whose braces' content stays, and commands without meaning.
WRAPPERS = frozenset(
    "text mathrm mathbf mathit operatorname mbox textrm textit textbf mathsf mathtt bm bar hat tilde dot ddot overline underline widehat "
    "widetilde boldsymbol mit".split()
)
DROPPED = frozenset("left right big Big bigg Bigg displaystyle textstyle scriptstyle limits nolimits quad qquad thinspace negthinspace".split())
#: Characters with a raised and a lowered form, operators whose script goes into brackets, and symbols that stand
#: close to the letter they precede.
RAISED = ("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ")
LOWERED = ("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ")
OPERATORS = "lim|max|min|log|ln|lg|exp|sin|cos|tan|cot|sec|csc|sum|prod|int|oint|arg|det|gcd|deg"
PREFIXES = "Α-Ωα-ω∇∂∑∏∫√±∓∘∀∃∠"

_COMMANDS = _greek() | SYMBOLS | dict.fromkeys(DROPPED, "")
_TOKEN = re.compile(
    r"\\(?:begin|end)\s*\{[^{}]*+\}|\\sqrt\s*+(?:\[(?P<degree>[^\]{}\\]{0,40})\]\s*+)?\{|\\(?P<name>[A-Za-z]+)(?P<gap>\s*+)(?P<open>\{)?|"
    r"\\\\|\\[\[\]()]|\\(?P<plain>[{}%&_])|[{}$]"
)
_SCRIPT = re.compile(r"([_^])\s*+(?:\{([^{}]*+)\}|([^\s{}]))")
_ON_OPERATOR = re.compile(rf"\b({OPERATORS})\s*+[_^]\s*+(?:\{{([^{{}}]*+)\}}|([A-Za-z0-9]))")
_SCRIPTS = {k: str.maketrans(*v) for k, v in (("^", RAISED), ("_", LOWERED))}
_ALPHABET = {"^": frozenset(RAISED[0]), "_": frozenset(LOWERED[0])}


def _symbols(s: str) -> str:
    """One pass: commands and groups become plain text; braces that no command owns stay, for scripts.

    Open groups are a stack of what closes them, so any depth is read in linear time without recursion.
    """
    out: list[str] = []
    closers: list[str] = []
    at = 0
    for m in _TOKEN.finditer(s):
        if m.start() < at:
            continue
        out.append(s[at : m.start()])
        at, token, name = m.end(), m[0], m["name"]
        if token.startswith("\\sqrt") and not name:
            out.append(f"{(m['degree'] or '').strip()}√(")
            closers.append(")")
        elif name in ("frac", "dfrac", "tfrac") and m["open"]:
            out.append("(")
            closers.append("/")
        elif name == "vec" and m["open"]:
            closers.append("→")
        elif name in WRAPPERS and m["open"]:
            closers.append("")
        elif name:
            out.append(_COMMANDS.get(name, name) + m["gap"])
            if m["open"]:
                out.append("{")
                closers.append("}")
        elif token == "\\\\":
            out.append("\n")
        elif m["plain"]:
            out.append(m["plain"])
        elif token == "{":
            out.append("{")
            closers.append("}")
        elif token == "}":
            close = closers.pop() if closers else "}"
            if close == "/":
                # the second group of a fraction follows at once, or is empty
                second = s.startswith("{", at)
                out.append(")/(" if second else ")/()")
                if second:
                    at += 1
                    closers.append(")")
            else:
                out.append(close)
    out.append(s[at:])
    out += [")/()" if c == "/" else "" if c == "}" else c for c in reversed(closers)]
    return "".join(out)


def _script(m: re.Match[str]) -> str:
    body = (m[2] if m[2] is not None else m[3]).strip()
    if body and _ALPHABET[m[1]].issuperset(body):
        return body.translate(_SCRIPTS[m[1]])
    return f"{m[1]}({body})"


def plain(s: str | None) -> str | None:
    """A text with LaTeX as readable plain text: fractions as (a)/(b), roots as n√(a), vectors as a→, scripts as raised characters.

    Unknown commands keep their name, so nothing is lost. A text without backslash and dollar stays as it is. Linear in the
    length of the text, whatever it holds.
    """
    if not s or "\\" not in s and "$" not in s:
        return s
    s = _symbols(s)
    s = _ON_OPERATOR.sub(lambda m: f"{m[1]}({m[2] if m[2] is not None else m[3]})", s)
    s = _SCRIPT.sub(_script, s)
    s = re.sub(rf"([{PREFIXES}])\s+(?=[A-Za-z0-9])", r"\1", s)
    s = re.sub(r"(?:begin|end)\s*\{[^{}]*\}", "", s)
    s = re.sub(r"(?<=[^\n])&(?=[^\n])", " ", s)
    s = re.sub(r"\\(?![A-Za-z0-9])", "", s)
    s = re.sub(r"[ \t]{2,}", " ", "\n".join(line.strip() for line in s.split("\n")))
    return re.sub(r"\n{3,}", "\n\n", s)


def _plain(text: pd.Series) -> pd.Series:
    return text.map(plain, na_action="ignore")


def strip_latex(text: Column) -> Column:
    return F.pandas_udf(_plain, "string")(text)


def clean_text(text: Column) -> Column:
    """LaTeX first, then misread glyphs: a glyph that follows a command must not become part of its name. Idempotent."""
    return fix_glyphs(strip_latex(text))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by matching blocks, 0 to 1."""
    return F.pandas_udf(_ratio, "double")(a, b)


def best_window(text: str, phrase: str) -> tuple[int, float]:
    words, n = (text or "").lower().split(), len(phrase.split())
    scored = [(SequenceMatcher(None, " ".join(words[i : i + n]), phrase.lower()).ratio(), -i) for i in range(len(words) - n + 1)]
    score, i = max(scored, default=(0.0, 1))
    return -i, score


def fuzzy_removed(phrases: tuple[str, ...], threshold: float = 0.85):
    """A UDF that takes the best window of words like each phrase out of a text."""

    def run(text: pd.Series) -> pd.Series:
        def one(s):
            for p in phrases:
                i, score = best_window(s, p)
                if score >= threshold:
                    words = s.split()
                    s = " ".join(words[:i] + words[i + len(p.split()) :])
            return s

        return text.map(lambda s: None if s is None else one(s))

    return F.pandas_udf(run, "string")
