"""What a reader sees of a text in wiki markup."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<(/?)ref\b[^<>]*?(/?)>", re.I)
_BLOCK = re.compile(r"</?(?:br|p|div|blockquote|li|ul|ol|dl|dt|dd|tr|td|th|table|hr|h[1-6]|center|gallery|poem)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BRACES = re.compile(r"\{\{|\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_URL = re.compile(r"\[(?:https?:|ftp:)?//[^\s\]]+[ \t]*([^\]\n]*)\]")
_FILE = re.compile(r"\s*(?:file|image|media|datei|bild|fichier|archivo|imagen|файл|изображение)\s*:", re.I)
_ASIDE = re.compile(r"\s*(?:category|kategorie|catégorie|categoría|категория|[a-z]{2,3}(?:-[a-z]+)*)\s*:", re.I)
_TABLE = re.compile(r"^[ \t:]*(?:\{\||\|-|\|\})[^\n]*", re.M)
_CELL = re.compile(r"^([ \t]*[|!])[^|\[\]\n]*=[^|\[\]\n]*\|(?!\|)", re.M)
_MAGIC = re.compile(r"__[A-Z]+__")
_QUOTES = re.compile(r"'{2,}")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
# UTF-8 read as Latin-1 or Windows-1252.
_TWICE = re.compile("[Â-ô](?:[\u0080-¿]|[€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]){1,3}")
_WORD = re.compile(r"[^\W_]+")
# What html.unescape reads as an entity, and runs that normalisation may join, with the character before them.
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_NOT_ASCII = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")


def _once(m: re.Match) -> str:
    for as_read in ("latin-1", "cp1252"):
        try:
            return m[0].encode(as_read).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


class _Text:
    """A text that is edited step by step."""

    def __init__(self, text: str):
        self.text = text

    def sub(self, pattern: re.Pattern, new) -> None:
        self.text = pattern.sub(new, self.text)

    def cut(self, spans: list[tuple[int, int]]) -> None:
        """A space for each of the outermost ``spans``, which are disjoint or nested."""
        self._replace([(a, b, " ") for a, b in _outermost(spans)])

    def _replace(self, edits: list[tuple[int, int, str]]) -> None:
        out, at = [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            at = b
        self.text = "".join([*out, self.text[at:]])

    def unescape(self) -> None:
        self.text = html.unescape(self.text)

    def normalize(self) -> None:
        self.text = unicodedata.normalize("NFKC", self.text)


class _Traced(_Text):
    """The same, with the place in the first text of each character."""

    def __init__(self, text: str):
        super().__init__(text)
        self.at = list(range(len(text) + 1))

    def sub(self, pattern: re.Pattern, new) -> None:
        self._replace([(m.start(), m.end(), m.expand(new) if isinstance(new, str) else new(m)) for m in pattern.finditer(self.text)])

    def _replace(self, edits: list[tuple[int, int, str]]) -> None:
        at, last = [], 0
        for a, b, new in edits:
            # What stays of the old text keeps its places; else all is where the old text began.
            kept = self.text.find(new, a, b) if new else -1
            at += self.at[last:a] + (self.at[kept : kept + len(new)] if kept >= 0 else [self.at[a]] * len(new))
            last = b
        super()._replace(edits)
        self.at = at + self.at[last:]

    def unescape(self) -> None:
        self.sub(_ENTITY, lambda m: html.unescape(m[0]))

    def normalize(self) -> None:
        self.sub(_NOT_ASCII, lambda m: unicodedata.normalize("NFKC", m[0]))

    def lower(self) -> None:
        sizes = [len(c.lower()) for c in self.text]
        self.at = [p for p, n in zip(self.at, sizes) for _ in range(n)] + self.at[-1:]
        self.text = self.text.lower()


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out.append((a, b))
            at = b
    return out


def _references(t: _Text) -> None:
    spans, opened = [], None
    for m in _REF.finditer(t.text):
        if m[2]:
            spans.append(m.span())
        elif not m[1]:
            opened = m.start()
        elif opened is not None:
            spans.append((opened, m.end()))
            opened = None
    t.cut(spans)


def _templates(t: _Text) -> None:
    """Closed templates go, nested ones too; the braces of an unclosed one hide nothing."""
    spans, opened = [], []
    for m in _BRACES.finditer(t.text):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            spans.append((opened.pop(), m.end()))
    t.cut(spans)


def _label(m: re.Match) -> str:
    target, bar, label = m[1].partition("|")
    if _FILE.match(target):
        return " " + label.rpartition("|")[2] + " " if bar else " "
    if _ASIDE.match(target):
        return " "
    return label if label.strip() else target.lstrip(":")


def _show(t: _Text) -> None:
    if not t.text.isascii():
        t.sub(_TWICE, _once)
    if "<" in t.text:
        t.sub(_COMMENT, "")
        _references(t)
    if "{{" in t.text:
        _templates(t)
    if "<" in t.text:
        t.sub(_BLOCK, " ")
        t.sub(_TAG, "")
    if "[" in t.text:
        before = None
        while "[[" in t.text and t.text != before:
            before = t.text
            t.sub(_LINK, _label)
        t.sub(_URL, r"\1")
    if "{|" in t.text or "|-" in t.text:
        t.sub(_TABLE, "")
        t.sub(_CELL, r"\1")
    if "''" in t.text:
        t.sub(_QUOTES, "")
    if "__" in t.text:
        t.sub(_MAGIC, "")
    if "&" in t.text:
        t.unescape()
    if not t.text.isascii():
        t.normalize()
        t.sub(_INVISIBLE, "")


def visible(text: str) -> str:
    """Without comments, references, templates, tags, link targets, entities and invisible characters; lines stay lines.

    Inline tags and invisible characters do not part a word; block tags, references and templates do.
    """
    t = _Text(text)
    _show(t)
    return t.text


def words(text: str) -> list[str]:
    """Runs of letters and digits of what a reader sees, in lower case."""
    return _WORD.findall(visible(text).lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """:func:`words`, each with the place in ``text`` where it begins, and where it ends; several times slower."""
    t = _Traced(text)
    _show(t)
    t.lower()
    return [(m[0], t.at[m.start()], t.at[m.end() - 1] + 1) for m in _WORD.finditer(t.text)]
