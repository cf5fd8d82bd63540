"""One scan of a text for all word lists (F2-F6, F11, T7-T10): an Aho-Corasick automaton over every word of every list.

`marks` gives a text one array of (list, word, start, stop): the first place of each word or pattern that is there, by list
and by place in its list. Every rule about lists is a test on that array, in the JVM, and a plan holds no list at all.

Words match the lower-cased text anywhere ("part"), between characters that are no letter or digit ("whole"), or so with a
plural ending ("plural"). Patterns are searched beside the automaton, where a word that they need stands.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as D
from .repeats import remembered

_KINDS = [(share, w) for share, words in D.FIRMNESS.items() for w in words]
#: Every list: how its words match, and the words.
LISTS: dict[str, tuple[str, list[str]]] = {
    "trigger": ("whole", D.ORDER_TRIGGERS), "non_order": ("part", D.NON_ORDER), "generic": ("part", D.GENERIC_HEADLINES), "never": ("part", D.NEVER_ORDER), "kind": ("plural", [w for _, w in _KINDS]),
    "bump": ("part", list(D.QUALITY_BUMPS)), "ding": ("whole", list(D.QUALITY_DINGS)), "amendment": ("whole", D.AMENDMENTS), "topic": ("part", D.NOT_ORDER_TOPICS),
    "psu": ("part", D.PUBLIC_SECTOR), "government": ("part", D.GOVERNMENT), "export": ("part", D.EXPORT), "category": ("part", D.ORDER_CATEGORIES), "book": ("part", D.BOOK_MENTIONS),
}
#: Lists of patterns, and words of which a text must hold one before any of them can match.
PATTERNS: dict[str, tuple[list[str], list[str]]] = {
    "order_pattern": (D.ORDER_PATTERNS, ["order", "contract", "loa", "tender", "project"]), "non_order_pattern": (D.NON_ORDER_PATTERNS, ["order", "rating"]),
    "own_project": (D.OWN_PROJECT, ["for", "capital", "capex", "funded", "expansion", "expected", "peak", "full", "commercial", "own", "proposed"]),
}
NUMBER = {name: k for k, name in enumerate([*LISTS, *PATTERNS])}
MARKS = T.ArrayType(T.StructType([T.StructField("list", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]), False)


@lru_cache(1)
def _automaton():
    import ahocorasick

    by_word: dict[str, list[tuple[int, int, str]]] = {}
    for name, (how, words) in LISTS.items():
        for k, w in enumerate(words):
            by_word.setdefault(w, []).append((NUMBER[name], k, how))
    out = ahocorasick.Automaton()
    for w, owners in by_word.items():
        out.add_word(w, (len(w), tuple(owners)))
    out.make_automaton()
    return out


def sure(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds, lower-cased; empty where none is sure.

    Groups, classes, escapes and letters that a quantifier follows are left out; so is all of a pattern of alternatives.
    """
    while (bare := re.sub(r"\((?:[^()\\]|\\.)*\)", "\0", pattern)) != pattern:
        pattern = bare
    pattern = re.sub(r"\\.|\[[^\]]*\]", "\0", pattern)
    return "" if "|" in pattern else max(re.findall("[A-Za-z ]+", re.sub(r".[*?{]", "\0", pattern)), key=len, default="").lower()


@lru_cache(1)
def _patterns() -> list[tuple[int, int, list[str], str, re.Pattern]]:
    return [(NUMBER[name], k, need, sure(p), re.compile(p, re.I)) for name, (patterns, need) in PATTERNS.items() for k, p in enumerate(patterns)]


def _joins(c: str) -> bool:
    return c.isascii() and c.isalnum()


@remembered
def find(text: str | None, lists: tuple[str, ...] = tuple(PATTERNS)) -> list[tuple[int, int, int, int]]:
    """The first place of each word of each list, and of each pattern of some lists: (list, word, start, stop), sorted by list and word."""
    if not text:
        return []
    low, out = text.lower(), {}
    for last, (n, owners) in _automaton().iter(low):
        start, stop = last + 1 - n, last + 1
        for number, k, how in owners:
            if (number, k) in out:
                continue
            if how != "part":
                if start and _joins(low[start - 1]):
                    continue
                end = stop
                if how == "plural" and end < len(low) and _joins(low[end]):
                    end += 2 if low.startswith("es", end) and not _joins(low[end + 2 : end + 3]) else 1 if low[end] == "s" else 0
                if _joins(low[end : end + 1]):
                    continue
            out[number, k] = (start, stop)
    said = low if len(low) == len(text) else text
    wanted = {NUMBER[name] for name in lists}
    plain = low if low.isascii() else low.replace("ſ", "s").replace("ı", "i").replace("\u0307", "")  # letters that a pattern takes for these
    for number, k, need, run, p in _patterns():
        if number in wanted and run in plain and any(w in low for w in need) and (m := p.search(said)):
            out[number, k] = m.span()
    return [(*key, *at) for key, at in sorted(out.items())]


@F.udf(MARKS, useArrow=True)
def marks(text):
    return find(text)


@F.udf(MARKS, useArrow=True)
def order_marks(text):
    """`marks` without the signs of an own project."""
    return find(text, ("order_pattern", "non_order_pattern"))


@F.udf(MARKS, useArrow=True)
def word_marks(text):
    """`marks` of words alone."""
    return find(text, ())


def has(found: str, *lists: str) -> Column:
    """Whether the marks in column `found` hold one of any of these lists."""
    return F.expr(f"exists({found}, m -> m.list IN ({', '.join(str(NUMBER[n]) for n in lists)}))")


def looks_like_order(found: str) -> Column:
    """F2."""
    return has(found, "trigger", "order_pattern")


def non_order(found: str, text: str) -> Column:
    """the first marker, by list order, that makes the text no commercial order; else null. Words come before patterns."""
    numbers = f"{NUMBER['non_order']}, {NUMBER['non_order_pattern']}"
    return F.expr(f"transform(array(array_min(filter({found}, m -> m.list IN ({numbers})))), m -> substring(lower({text}), m.start + 1, m.stop - m.start))[0]")


def worth_probe(found: str) -> Column:
    """F4, of the marks of headline and subcategory: a headline that says nothing, and none that can never be an order."""
    return has(found, "generic") & ~has(found, "never", "non_order", "non_order_pattern")


def own_project(found: str) -> Column:
    """signs that the company builds for itself."""
    return F.expr(f"size(filter({found}, m -> m.list = {NUMBER['own_project']})) >= {D.OWN_PROJECT_LEAST}")


def order_type(found: str) -> Column:
    """struct(order_type, firmness) of the firmest phrase."""
    kinds = ", ".join(f"struct('{w}' AS order_type, {share}D AS firmness)" for share, w in _KINDS)
    return F.expr(f"coalesce(get(array({kinds}), array_min(filter({found}, m -> m.list = {NUMBER['kind']})).word), struct('unknown' AS order_type, 0.5D AS firmness))")


def quality_adjustment(found: str) -> Column:
    """Bumps match anywhere, dings whole words; between -0.4 and 0.5."""
    points = lambda d: "array(" + ", ".join(f"{p}D" for p in d.values()) + ")"
    each = f"if(m.list = {NUMBER['bump']}, get({points(D.QUALITY_BUMPS)}, m.word), get({points(D.QUALITY_DINGS)}, m.word))"
    return F.expr(f"greatest(-0.4D, least(0.5D, aggregate(filter({found}, m -> m.list IN ({NUMBER['bump']}, {NUMBER['ding']})), 0.0D, (s, m) -> s + {each})))")


def customer_type(name: Column, *found: str) -> Column:
    """T7, of the marks of the name and of the text."""
    any_of = lambda kind: F.expr(" OR ".join(f"exists({f}, m -> m.list = {NUMBER[kind]})" for f in found))
    return F.when(any_of("psu"), "psu").when(any_of("government"), "government").when(any_of("export"), "export").when(name.isNotNull(), "private").otherwise("unknown")
