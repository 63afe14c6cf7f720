"""Whole-word matching of a word list, in one pass over a text and in the row.

A list becomes one pattern in the shape of a trie, tried at every word; a small
map gives the list's terms for each match. Nothing is exploded, joined or
shuffled, so the cost grows with the text and hardly with the list. For lists
of many thousands of terms see ``rules.match_gazetteer``.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of at most so many letters are matched in their own case.
SHORT = 4


def trie_pattern(terms: list[str]) -> str:
    """A pattern of any of the terms, the longest first at each place."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(c) + render(below) for c, below in node.items() if c]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        return f"(?:{'|'.join(branches)}){'?' if '' in node else ''}"

    return render(root)


def _begins(short: str, whole: str) -> bool:
    """Whether ``short`` stands as whole words at the start of ``whole``."""
    return whole.startswith(short) and (whole == short or re.match(r"\w", whole[len(short)]) is None or re.match(r"\w", short[-1]) is None)


def _found(text: Column, forms: dict[str, list[str]]) -> Column:
    """The values of the forms that stand as whole words in a text."""
    if not forms:
        return F.expr("array()").cast("array<string>")
    pattern = rf"\b(?=({trie_pattern(list(forms))})\b)"
    # At a place only the longest form is seen; the shorter ones that begin it
    # are known beforehand.
    each = {f: list(dict.fromkeys(v for g in forms if _begins(g, f) for v in forms[g])) for f in forms}
    table = F.create_map(*[x for f, values in each.items() for x in (F.lit(f), F.array(*map(F.lit, values)))])
    seen = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))
    return F.flatten(F.transform(seen, lambda f: F.element_at(table, f)))


def any_part(parts: list[str]) -> str:
    """A pattern for ``may_have`` of texts that have a part anywhere, in any case."""
    if not all(p and p.isascii() for p in parts):
        return ""
    # Two letters beyond ASCII have a lower case with letters of ASCII.
    return rf"(?i:{trie_pattern([p.lower() for p in parts])})|[\x{{130}}\x{{212A}}]"


def any_term(terms: list[str], keep_short: bool = False) -> str:
    """A pattern for ``may_have`` of texts that have a term as whole words, in any
    case; with ``keep_short`` names of up to four letters in their own case."""
    if not all(t and t.isascii() for t in terms):
        return ""
    edged = [t for t in terms if re.fullmatch(r"\w(.*\w)?", t)]
    own = [t for t in edged if keep_short and len(t) <= SHORT]
    plain = [t.lower() for t in edged if not (keep_short and len(t) <= SHORT)]
    loose = [t for t in terms if t not in edged]
    parts = [rf"\b(?:{trie_pattern(own)})\b"] if own else []
    if plain:
        parts.append(rf"(?i:\b(?:{trie_pattern(plain)})\b)|[\x{{130}}\x{{212A}}]")
    return "|".join(parts + ([any_part(loose)] if loose else []))


def may_have(text: Column, *patterns: str) -> Column:
    """Bits, the first pattern's the lowest: set if the pattern (of RE2) fits a text.

    Patterns of ``any_term`` and ``any_part`` fit every text that has a term, and some
    others: their word edges are those of ASCII, and any white space is a space. One
    automaton a pattern reads the text once, far faster than the search for the terms,
    which texts without any are then spared.
    """
    wide = [p.replace("\\ ", r"[\s\x0b]") for p in patterns]

    def seen(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int64)
        for i, pattern in enumerate(wide):
            bits |= pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False).astype(np.int64) << i
        return pa.array(bits)

    return F.arrow_udf(seen, "long")(text)


def is_set(bits: str, pattern: int) -> Column:
    """Whether ``may_have`` has set the bit of a pattern."""
    return F.col(bits).bitwiseAND(1 << pattern) != 0


def terms_in_text(text: Column, terms: list[str] | dict[str, str], keep_short: bool = False, lowered: bool = False) -> Column:
    """The terms that stand as whole words in a text, sorted and distinct.

    ``terms``: a list, or a map from forms to what they mean. Case does not
    count, but with ``keep_short`` names of up to four letters keep their own.
    ``lowered``: the text is in lower case already.
    """
    pairs = terms.items() if isinstance(terms, dict) else [(t, t) for t in terms]
    plain: dict[str, list[str]] = {}
    own: dict[str, list[str]] = {}
    for form, value in pairs:
        kept = keep_short and len(form) <= SHORT
        (own if kept else plain).setdefault(form if kept else form.lower(), []).append(value)
    parts = [_found(text if lowered else F.lower(text), plain)] + ([_found(text, own)] if own else [])
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def grouped_terms(text: Column, groups: dict[str, list[str]], keep_short: tuple[str, ...] = (), lowered: Column | None = None) -> Column:
    """The terms of several lists that a text has, in one pass over it: strings
    ``group:term`` for ``of_group``. ``keep_short`` names the groups whose names
    of up to four letters keep their case; ``lowered`` is the text in lower case.
    """
    plain: dict[str, list[str]] = {}
    own: dict[str, list[str]] = {}
    for group, terms in groups.items():
        for term in terms:
            kept = group in keep_short and len(term) <= SHORT
            (own if kept else plain).setdefault(term if kept else term.lower(), []).append(f"{group}:{term}")
    parts = [_found(F.lower(text) if lowered is None else lowered, plain)] + ([_found(text, own)] if own else [])
    return F.concat(*parts)


def of_group(found: Column, group: str) -> Column:
    """The terms of one group, sorted and distinct."""
    mine = F.filter(found, lambda t: t.startswith(f"{group}:"))
    return F.array_sort(F.array_distinct(F.transform(mine, lambda t: F.substring(t, len(group) + 2, 1000))))


def spaced(text: Column) -> Column:
    """The lower-case words of letters a-z and digits, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def runs_in_text(spaced_text: Column, forms: dict[str, str]) -> Column:
    """The values of the word runs that a ``spaced`` text has, sorted and distinct;
    forms count by their own words."""
    plain: dict[str, list[str]] = {}
    for form, value in forms.items():
        words = " ".join(re.findall("[a-z0-9]+", form.lower()))
        if words:
            plain.setdefault(words, []).append(value)
    return F.array_sort(F.array_distinct(_found(spaced_text, plain)))


def in_order(found: Column, terms: list[str], most: int | None = None) -> Column:
    """The found terms in the order of the list."""
    listed = F.array(*map(F.lit, terms))
    placed = F.array_sort(F.transform(found, lambda t: F.struct(F.array_position(listed, t).alias("at"), t.alias("term"))))
    kept = F.transform(placed, lambda x: x["term"])
    return F.slice(kept, 1, most) if most else kept


def apart(column: str, use) -> Column:
    """``use(column)`` for an array column that ``use`` takes into a function of
    elements. The column is named twice, so that the optimizer does not move what
    computes it into that function, to be computed for every element."""
    return F.when(F.size(column) >= 0, use(F.col(column)))


def contains_word(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring of a text; null has none."""
    if not words:
        return F.lit(False)
    return F.coalesce(text.rlike(trie_pattern(words)), F.lit(False))


def look_up(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """A small map's value, else the default (null)."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def union_of(groups: dict[str, list[str]]) -> list[str]:
    """The distinct terms of all groups, in order."""
    return list(dict.fromkeys(reduce(lambda a, b: a + b, groups.values(), [])))
