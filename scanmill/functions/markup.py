"""Visible text of HTML pages, by the states of the HTML standard's tokenizer.

Each state jumps to the next character that can end it, so the work is a few searches for
each tag.  No tree is built: which tags end blocks, hide their content or hold it as raw text
is all that the text of a page hangs on.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa

from scanmill.functions.words import BLOCK_ELEMENTS

_BLANK = "\t\n\f\r "
_OPEN = re.compile(r"<(?=[A-Za-z!?/])")
_NAME = re.compile(rf"[^{_BLANK}/>]*")
_BETWEEN = re.compile(rf"[{_BLANK}/]*")
_ATTRIBUTE = re.compile(rf"=?[^{_BLANK}/>=]*[{_BLANK}]*")
_VALUE_START = re.compile(rf"=[{_BLANK}]*")
_UNQUOTED = re.compile(rf"[^{_BLANK}>]*")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT_MARK = re.compile(rf"<!--|-->|</?script(?=[{_BLANK}/>])", re.IGNORECASE)

# Elements whose content is no markup: hidden, or text as it stands, or with references decoded.
_HIDDEN = frozenset({"script", "style"})
_RAW_TEXT = frozenset({"xmp", "iframe", "noembed", "noframes"})
_ESCAPABLE = frozenset({"title", "textarea"})
_FOREIGN = frozenset({"svg", "math"})
_BLOCKS = frozenset(BLOCK_ELEMENTS)
_CLOSING = {
    name: re.compile(rf"</{name}(?=[{_BLANK}/>])", re.IGNORECASE) for name in _RAW_TEXT | _ESCAPABLE | {"style"}
}


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """Where a tag ends whose name ends at `at` (or -1 at the end of the page), and whether it closes itself."""
    end = page.find(">", at)
    if end < 0:
        return -1, False
    quoted = page.find('"', at, end) >= 0 or page.find("'", at, end) >= 0
    if not quoted and page[end - 1] != "/":
        return end + 1, False
    while True:
        start, at = at, _BETWEEN.match(page, at).end()
        if at == len(page):
            return -1, False
        if page[at] == ">":
            return at + 1, at > start and page[at - 1] == "/"
        at = _ATTRIBUTE.match(page, at).end()
        value = _VALUE_START.match(page, at)
        if not value:
            continue
        at = value.end()
        quote = page[at : at + 1]
        if quote in ('"', "'"):
            at = page.find(quote, at + 1) + 1
            if not at:
                return -1, False
        else:
            at = _UNQUOTED.match(page, at).end()


def _script_end(page: str, at: int) -> int:
    """Where the end tag of a script begins, or -1.

    In a comment, a nested `<script` hides the next `</script`.
    """
    commented = nested = False
    while found := _SCRIPT_MARK.search(page, at):
        mark = found.group().lower()
        at = found.end()
        if mark == "<!--":
            commented = True
            at -= 2  # its dashes may also be those of `-->`
        elif mark == "-->":
            commented = nested = False
        elif mark == "<script":
            nested = commented
        elif nested:
            nested = False
        else:
            return found.start()
    return -1


def _declaration_end(page: str, at: int, foreign: bool) -> tuple[int, str]:
    """Where what begins with `<!` or `<?` at `at` ends (or -1), and the text in it."""
    if page.startswith("<!--", at):
        for short in (">", "->"):
            if page.startswith(short, at + 4):
                return at + 4 + len(short), ""
        found = _COMMENT_END.search(page, at + 4)
        return (found.end() if found else -1), ""
    if foreign and page.startswith("<![CDATA[", at):
        end = page.find("]]>", at + 9)
        return (-1, page[at + 9 :]) if end < 0 else (end + 3, page[at + 9 : end])
    return page.find(">", at) + 1 or -1, ""


def visible_text(page: str) -> str:
    """Text of a page, references decoded; block tags leave a blank.

    A tag, comment or hidden element that the page's end cuts off has no text.
    """
    parts: list[str] = []
    at = 0
    foreign = False

    def say(start: int, end: int | None, references: bool = True) -> None:
        text = page[start:end]
        parts.append(html.unescape(text) if references and "&" in text else text)

    while at >= 0:
        found = _OPEN.search(page, at)
        say(at, found.start() if found else None)
        if not found:
            break
        start = found.start()
        sign = page[start + 1]
        if sign in "!?":
            at, text = _declaration_end(page, start, foreign)
            parts.append(text)
            continue
        closing = sign == "/"
        first = page[start + 1 + closing : start + 2 + closing]
        if not (first.isascii() and first.isalpha()):
            if not first:
                parts.append("</")
                break
            at = page.find(">", start) + 1 or -1  # `</>`, or a comment in disguise
            continue
        named = _NAME.match(page, start + 1 + closing)
        name = named.group().lower()
        at, closed = _tag_end(page, named.end())
        if name in _BLOCKS:
            parts.append(" ")
        if at < 0:
            break
        if name in _FOREIGN:
            foreign = not closing and not closed
        elif name in _BLOCKS and not closing:
            foreign = foreign and name in _ESCAPABLE | _HIDDEN
        if closing:
            continue
        if name == "plaintext":
            say(at, None, references=False)
            break
        if name == "script":
            at = _script_end(page, at)
        elif name in _HIDDEN or name in _RAW_TEXT or name in _ESCAPABLE and not foreign:
            ends = _CLOSING[name].search(page, at)
            if name not in _HIDDEN:
                say(at, ends.start() if ends else None, references=name in _ESCAPABLE)
            at = ends.start() if ends else -1
    return "".join(parts)


def visible_texts(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else visible_text(p) for p in pages.to_pylist()], pa.string())
