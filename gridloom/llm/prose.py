"""Splitting a document's text into prose sentences; code, logs, links and markup are left out."""

from __future__ import annotations

import re
import unicodedata

_FENCE = re.compile(r"^\s*(```|~~~)")
_PRE = re.compile(r"<pre\b.*?(?:</pre\s*>|\Z)|<code\b.*?(?:</code\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[a-z][^<>\n]{0,200}>", re.I)
_LINK = re.compile(r"(?:https?|ftp)://\S+|www\.\S+", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_PLAIN = re.compile(r"^[\"'“”„«»‘’(\[¿¡*>\-–—]*[^\W\d_]+(?:['’\-/][^\W\d_]+)*[\"'“”„«»‘’)\]*.,:;!?…]*$")
#: Lines of such tokens only, the first a word, are prose without a closer look.
_SIMPLE = re.compile(r"^\s*[^\W\d_]++(?:['’\-][^\W\d_]++)*+[.,:;!?]?(?:\s++[^\W\d_]++(?:['’\-][^\W\d_]++)*+[.,:;!?]?)*+\s*$")
_NUMBER = re.compile(r"^[\W\d_]*$")
_CODE = re.compile(r"[_{}<>=$|&\\\[\];]|\w\(")
_END = re.compile(r"(?<=[.!?…])[\"'”»’)]*\s+")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
LEAST_PLAIN = 0.7
REMEMBERED = 200_000  # tokens whose kind is kept


def visible(text: str) -> str:
    """Without zero-width signs, compatibility forms (full-width digits, ligatures) as plain ones."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _UNSEEN.sub("", text))


def _token_kind(token: str) -> int:
    """2: a plain word, 1: code or the like, 0: a number or a sign."""
    return 2 if _PLAIN.match(token) else int(bool(_CODE.search(token)) or not _NUMBER.match(token))


def _is_prose(line: str, known: dict[str, int]) -> bool:
    if _SIMPLE.match(line):
        return True
    kinds = []
    for token in visible(line).split():
        kind = known.get(token)
        if kind is None:
            if len(known) >= REMEMBERED:
                known.clear()
            kind = known[token] = _token_kind(token)
        kinds.append(kind)
    plain, other = kinds.count(2), kinds.count(1)
    return plain > 0 and plain >= LEAST_PLAIN * (plain + other)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) offsets of the prose sentences of ``text``, see :func:`prose`."""
    return prose(text)[1]


def prose(text: str | None, known: dict[str, int] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with links, tags and code blanked out (offsets stay), and (start, end) of its prose sentences, in order.

    None and blank texts have none. ``known`` keeps what kind of tokens were seen before.

    Left out: fenced blocks, <pre> and <code> blocks, lines indented by four blanks or a tab, links, other tags, and
    lines of which less than LEAST_PLAIN of the tokens are plain words (numbers don't count either way).
    """
    if not text or text.isspace():
        return "", []
    known = {} if known is None else known
    blank = lambda m: " " * (m.end() - m.start())  # noqa: E731 - offsets stay as they are
    keep = lambda m: "".join(c if c in "\r\n" else " " for c in m.group())
    clean = _TAG.sub(blank, _PRE.sub(keep, text)) if "<" in text else text
    if "://" in clean or "www." in clean.lower():
        clean = _LINK.sub(blank, clean)
    out: list[tuple[int, int]] = []
    fenced, at = False, 0
    for line in clean.splitlines(keepends=True):
        start, at = at, at + len(line)
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or line.startswith(("    ", "\t")) or not _is_prose(line, known):
            continue
        from_ = start
        for m in _END.finditer(line):
            if clean[from_ : start + m.start()].strip():
                out.append((from_, start + m.start()))
            from_ = start + m.end()
        if clean[from_:at].strip():
            out.append((from_, at))
    return clean, out
