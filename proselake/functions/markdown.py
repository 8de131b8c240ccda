"""Markdown of one text: blocks by a stack of open containers, then inline markup by stacks of brackets and delimiter runs.

It follows the published CommonMark rules, with tables, strikethrough and footnotes. The result is a tree of blocks; `prose_of`,
`headings_of` and `table_ranges_of` read from it what the columns of `operators.documents` give. Everything is linear in
the text but for the depth of nested containers, which each line passes through.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata

from proselake.functions.text import WHITE

#: Elements that begin a block of their own, and those whose content is taken as it stands.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_VERBATIM = "script pre style textarea".split()

_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
#: How a block of HTML begins and what ends it; None: a blank line. The last kind cannot break into a paragraph.
_HTML = [
    (re.compile(rf"<(?:{'|'.join(_VERBATIM)})(?:[\s>]|$)", re.I), re.compile(rf"</(?:{'|'.join(_VERBATIM)})>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf"</?(?:{'|'.join(_ELEMENTS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_OPEN_TAG}|{_CLOSE_TAG})[ \t]*$", re.A), None),
]
_INLINE_HTML = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.A)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")

_END = re.compile(r"\r\n|\n|\r")
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_MARKER = re.compile(r"([-+*])|(\d{1,9})([.)])")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")

_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.)*)\]", re.S)
_POINTED = re.compile(r"<((?:[^<>\\\n]|\\.)*)>")
_TITLE = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)""", re.S)
_GAP = re.compile(r"[ \t]*(?:\n[ \t]*)?")
_TEXT = re.compile(r"[^\\`<&*_~\[\]!\n]+")
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_MARKS = frozenset(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Block:
    """A container (doc, quote, list, item, note) or a leaf (para, heading, code, html, table, rule, nothing)."""

    __slots__ = ("kind", "kids", "lines", "first", "last", "info", "tight")

    def __init__(self, kind: str, line: int, info=None):
        self.kind, self.kids, self.lines, self.first, self.last, self.info, self.tight = kind, [], [], line, line, info, True


class _Line:
    """What is left of a line, with the column it begins at, so that tabs reach to their stops within containers too."""

    def __init__(self, text: str):
        self.text, self.column = text, 0

    def indent(self) -> int:
        """Columns of white space ahead."""
        column = self.column
        for c in self.text:
            if c == "\t":
                column += 4 - column % 4
            elif c == " ":
                column += 1
            else:
                break
        return column - self.column

    def blank(self) -> bool:
        return not self.text.strip(" \t")

    def skip(self, columns: int) -> None:
        """Pass white space; what a tab has more than that stays as blanks."""
        at = 0
        while columns > 0 and at < len(self.text) and self.text[at] in " \t":
            width = 4 - self.column % 4 if self.text[at] == "\t" else 1
            self.column += min(width, columns)
            at += 1
            if width > columns:
                self.text = " " * (width - columns) + self.text[at:]
                return
            columns -= width
        self.text = self.text[at:]

    def take(self, chars: int) -> None:
        self.text, self.column = self.text[chars:], self.column + chars


def _cells(row: str) -> list[str]:
    """The cells of a row of a table; a bar after a backslash belongs to its cell, also in code."""
    row = row.strip(" \t")
    row = row[1:] if row.startswith("|") else row
    parts = re.split(r"(?<!\\)\|", row)
    if len(parts) > 1 and not parts[-1].strip(" \t"):
        parts.pop()
    return [p.strip(" \t").replace("\\|", "|") for p in parts]


class Document:
    """The blocks of a text, the labels of its link definitions and footnotes."""

    def __init__(self, text: str, notes: bool = False, tables: bool = True):
        self.root, self.labels, self.notes = Block("doc", 0), set(), set()
        self._with = notes, tables
        self._path, self._leaf = [self.root], None
        at = number = 0
        for m in _END.finditer(text):
            self._line(text[at : m.start()], number, at, m.start())
            at, number = m.end(), number + 1
        if at < len(text):
            self._line(text[at:], number, at, len(text))
        self._close(1)
        self._loose()

    # --- blocks

    def _close(self, depth: int) -> None:
        """Close all containers beyond `depth`, and the open leaf."""
        if self._leaf is not None and self._leaf.kind == "para":
            self._define(self._leaf)
            if not self._leaf.lines:
                self._leaf.kind = "nothing"
        self._leaf = None
        del self._path[depth:]

    def _define(self, para: Block) -> None:
        """Take link definitions off the start of a paragraph."""
        text, at = "\n".join(para.lines), 0
        while text.startswith("[", at) and (end := self._definition(text, at)) is not None:
            at = end
        if at:
            para.lines = text[at:].split("\n") if at < len(text) else []

    def _definition(self, text: str, at: int) -> int | None:
        m = _LABEL.match(text, at)
        if not m or not m[1].strip() or len(m[1]) > 999 or not text.startswith(":", m.end()):
            return None
        after = _target(text, _GAP.match(text, m.end() + 1).end())
        if after is None:
            return None
        gap = _GAP.match(text, after)
        title = _TITLE.match(text, gap.end()) if gap.end() > after else None
        for end in ([title.end()] if title else []) + [after]:
            rest = re.compile(r"[ \t]*(\n|$)").match(text, end)
            if rest and (rest[1] or rest.end() == len(text)):
                self.labels.add(_folded(m[1]))
                return rest.end()
        return None

    def _open(self, depth: int, block: Block, leaf: bool) -> None:
        # a list holds items only
        self._close(depth - 1 if block.kind != "item" and self._path[depth - 1].kind == "list" else depth)
        self._path[-1].kids.append(block)
        for b in self._path:
            b.last = max(b.last, block.last)
        if leaf:
            self._leaf = block
        else:
            self._path.append(block)

    def _went_on(self, number: int) -> None:
        for b in (*self._path, self._leaf):
            if b is not None:
                b.last = number

    def _line(self, raw: str, number: int, begin: int, end: int) -> None:
        line, depth = _Line(raw), 1
        quoted = 0
        while depth < len(self._path) and self._continues(self._path[depth], line):
            quoted = depth if self._path[depth].kind == "quote" else quoted
            depth += 1
        for b in self._path[: quoted + 1] if quoted else ():
            b.last = number
        whole, leaf = depth == len(self._path), self._leaf
        if whole and leaf is not None and leaf.kind in ("code", "html") and self._inside(leaf, line, number):
            return
        if leaf is not None and leaf.kind in ("code", "html", "table") and (not whole or line.blank()):
            self._leaf = leaf = None
        opened = False
        while not line.blank():
            para = self._leaf if self._leaf is not None and self._leaf.kind == "para" and not opened else None
            step = self._starts(line, number, depth, para, whole and not opened, begin, end)
            if step is None:
                break
            if step:
                return
            opened, depth, whole = True, len(self._path), True
        if line.blank():
            self._close(depth)
            return
        line.text = line.text.lstrip(" \t")
        leaf = None if opened else self._leaf
        if leaf is not None and leaf.kind == "para":
            # also from outside of its containers: a lazy continuation
            leaf.lines.append(line.text)
            self._went_on(number)
        elif leaf is not None and leaf.kind == "table":
            leaf.lines.append(line.text)
            leaf.info[1] = end
            self._went_on(number)
        else:
            para = Block("para", number, (line.text, end))
            para.lines.append(line.text)
            self._open(depth, para, True)

    def _continues(self, b: Block, line: _Line) -> bool:
        if b.kind == "quote":
            if line.indent() > 3 or not line.text.lstrip(" \t").startswith(">"):
                return False
            line.skip(3)
            self._quoted(line)
            return True
        if b.kind == "list":
            return True
        width = 4 if b.kind == "note" else b.info
        if line.blank():
            # an item that begins with a blank line has one only
            return bool(b.kids) or b.kind == "note"
        if line.indent() < width:
            return False
        line.skip(width)
        return True

    @staticmethod
    def _quoted(line: _Line) -> None:
        line.take(1)
        if line.indent():
            line.skip(1)

    def _inside(self, leaf: Block, line: _Line, number: int) -> bool:
        """Whether the line belongs to an open block of code or HTML."""
        if leaf.kind == "html":
            if leaf.info is None:
                if line.blank():
                    return False
            elif leaf.info.search(line.text):
                self._went_on(number)
                self._leaf = None
                return True
            self._went_on(number)
            return True
        if leaf.info is None:
            if line.indent() < 4 and not line.blank():
                self._leaf = None
                return False
            if not line.blank():
                self._went_on(number)
            return True
        self._went_on(number)
        bare = line.text.strip(" \t")
        if line.indent() < 4 and len(bare) >= len(leaf.info) and not bare.strip(leaf.info[0]):
            self._leaf = None
        return True

    def _starts(self, line: _Line, number: int, depth: int, para: Block | None, same: bool, begin: int, end: int) -> bool | None:
        """Begin the block that the line begins: True for a leaf, False for a container, None if it begins none.

        `para` is a paragraph that is still open, `same` whether the line stands in that paragraph's containers.
        """
        indent, text = line.indent(), line.text.lstrip(" \t")
        if indent > 3:
            if para is not None:
                return None
            self._open(depth, Block("code", number), True)
            return True
        if text[0] == ">":
            line.skip(3)
            self._open(depth, Block("quote", number), False)
            self._quoted(line)
            return False
        if m := _HEADING.match(text):
            self._open(depth, Block("heading", number, len(m[1])), True)
            self._leaf.lines.append(m[2] or "")
            self._leaf = None
            return True
        if m := _FENCE.match(text):
            self._open(depth, Block("code", number, m[1] or m[2]), True)
            return True
        if text[0] == "<":
            for k, (pattern, until) in enumerate(_HTML):
                if pattern.match(text) and (k < 6 or para is None):
                    self._open(depth, Block("html", number, until), True)
                    if until is not None and until.search(text):
                        self._leaf = None
                    return True
        if para is not None and same:
            if m := _UNDERLINE.match(text):
                self._define(para)
                if para.lines:
                    para.kind, para.info = "heading", 1 if m[1][0] == "=" else 2
                    self._went_on(number)
                    self._leaf = None
                    return True
            if self._with[1] and len(para.lines) == 1 and "|" in para.lines[0] and _DELIMITERS.match(text) and "-" in text and len(_cells(text)) == len(_cells(para.lines[0])):
                header, head_end = para.info
                para.kind, para.info = "table", [(header, head_end), end]
                self._went_on(number)
                return True
        if _RULE.match(text):
            self._open(depth, Block("rule", number), True)
            self._leaf = None
            return True
        if self._with[0] and (m := _NOTE.match(text)):
            self.notes.add(_folded(m[1]))
            line.skip(3)
            self._open(depth, Block("note", number), False)
            line.take(m.end())
            return False
        if m := _MARKER.match(text):
            return self._item(line, number, depth, para, same, m)
        return None

    def _item(self, line: _Line, number: int, depth: int, para: Block | None, same: bool, m: re.Match) -> bool | None:
        indent, after = line.indent(), _Line(line.text.lstrip(" \t")[m.end() :])
        after.column = line.column + indent + m.end()
        gap, empty = after.indent(), after.blank()
        if not empty and gap == 0:
            return None
        if para is not None and same and (empty or (m[2] and int(m[2]) != 1)):
            return None
        width = indent + m.end() + (1 if empty or gap > 4 else gap)
        mark = m[1] or m[3]
        holder = self._path[depth - 1]
        if holder.kind != "list" or holder.info != mark:
            self._open(depth, Block("list", number, mark), False)
            depth = len(self._path)
        after.skip(1 if gap > 4 else gap)
        line.text, line.column = after.text, after.column
        self._open(depth, Block("item", number, width), False)
        return False

    def _loose(self) -> None:
        """A list is loose if a blank line parts two of its items, or two blocks of one of them."""
        todo = [self.root]
        while todo:
            b = todo.pop()
            todo += b.kids
            if b.kind == "list":
                rows = [b.kids, *(item.kids for item in b.kids)]
                b.tight = not any(y.first - x.last > 1 for row in rows for x, y in zip(row, row[1:], strict=False))

    # --- what is read from the tree

    def leaves(self):
        """(leaf, whether it stands in an item of a tight list) in the order of the text."""
        todo = [(self.root, False)]
        while todo:
            b, tight = todo.pop()
            if b.kids or b.kind in ("doc", "quote", "list", "item", "note"):
                todo += [(kid, b.tight if b.kind == "list" else tight if b.kind == "item" else False) for kid in reversed(b.kids)]
            else:
                yield b, tight

    def plain(self, text: str, code: bool = False, gap: str = " ") -> str:
        return Inline(self, text, code, gap).text()


def _target(text: str, at: int) -> int | None:
    """The end of a link's target, in angle brackets or without blanks and with balanced parentheses."""
    if text.startswith("<", at):
        m = _POINTED.match(text, at)
        return m.end() if m else None
    begin, deep = at, 0
    while at < len(text) and text[at] > " " and text[at] != "\x7f":
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] in _MARKS:
            at += 1
        elif c == "(":
            deep += 1
            if deep > 32:
                return None
        elif c == ")":
            if not deep:
                break
            deep -= 1
        at += 1
    return at if at > begin and not deep else None


def _folded(label: str) -> str:
    return " ".join(label.split()).casefold()


def _white(c: str) -> bool:
    return not c or c in WHITE


def _mark(c: str) -> bool:
    return bool(c) and (c in _MARKS or (not c.isascii() and unicodedata.category(c)[0] in "PS"))


class _Run:
    """A run of delimiters: its place among the parts, what is left of it, and which ways it may work."""

    __slots__ = ("part", "char", "left", "size", "opens", "closes")

    def __init__(self, part: int, char: str, size: int, before: str, after: str):
        left = not _white(after) and (not _mark(after) or _white(before) or _mark(before))
        right = not _white(before) and (not _mark(before) or _white(after) or _mark(after))
        self.part, self.char, self.left, self.size = part, char, size, size
        self.opens = left and (char != "_" or not right or _mark(before))
        self.closes = right and (char != "_" or not left or _mark(after))
        if char == "~" and size > 2:
            self.opens = self.closes = False

    def pairs(self, closer: _Run) -> bool:
        if self.char != closer.char or not self.opens:
            return False
        if self.char == "~":
            return self.size == closer.size
        # a run that may work both ways pairs with one if their sizes do not add up to a multiple of three, or both are one
        both = self.closes or closer.opens
        return not both or (self.size + closer.size) % 3 != 0 or (self.size % 3 == 0 and closer.size % 3 == 0)


class Inline:
    """The text of a leaf without its markup: parts, of which delimiters and brackets go when they find their partner."""

    def __init__(self, doc: Document, text: str, code: bool, gap: str):
        self.doc, self.s, self.code, self.gap = doc, text, code, gap
        self.parts: list[str] = []
        self.runs: list[_Run] = []
        self.brackets: list[list] = []  # [part, number of runs below, place after it, active]
        self.ticks: dict[int, int] = {}  # of a length of backticks: the place from which none follows

    def text(self) -> str:
        at, s = 0, self.s.rstrip(" \t\n")
        self.s = s
        while at < len(s):
            if m := _TEXT.match(s, at):
                self.parts.append(m[0])
                at = m.end()
            else:
                at = getattr(self, _STEPS[s[at]])(at)
        self._pair(0)
        return "".join(self.parts)

    def _literal(self, at: int, chars: int = 1) -> int:
        self.parts.append(self.s[at : at + chars])
        return at + chars

    def _backslash(self, at: int) -> int:
        after = self.s[at + 1 : at + 2]
        if after == "\n":
            return self._newline(at + 1)
        if after in _MARKS and after:
            self.parts.append(after)
            return at + 2
        return self._literal(at)

    def _newline(self, at: int) -> int:
        if self.parts:
            self.parts[-1] = self.parts[-1].rstrip(" ")
        self.parts.append(self.gap)
        at += 1
        while self.s[at : at + 1] in (" ", "\t") and at < len(self.s):
            at += 1
        return at

    def _backtick(self, at: int) -> int:
        end = at
        while self.s.startswith("`", end):
            end += 1
        size = end - at
        if self.ticks.get(size, len(self.s) + 1) > at:
            for m in re.compile(r"`+").finditer(self.s, end):
                if m.end() - m.start() == size:
                    if self.code:
                        inner = self.s[end : m.start()].replace("\n", " ")
                        self.parts.append(inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip(" ") else inner)
                    else:
                        self.parts.append("")
                    return m.end()
            self.ticks[size] = at
        return self._literal(at, size)

    def _angle(self, at: int) -> int:
        if m := _AUTOLINK.match(self.s, at):
            self.parts.append(m[1])
            return m.end()
        if m := _INLINE_HTML.match(self.s, at):
            self.parts.append("")
            return m.end()
        return self._literal(at)

    def _entity(self, at: int) -> int:
        m = _ENTITY.match(self.s, at)
        if not m:
            return self._literal(at)
        if m[3]:
            known = html.entities.html5.get(m[3] + ";")
            if known is None:
                return self._literal(at)
            self.parts.append(known)
        else:
            n = int(m[1], 16) if m[1] else int(m[2])
            self.parts.append(chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�")
        return m.end()

    def _delimiter(self, at: int) -> int:
        end = at
        while end < len(self.s) and self.s[end] == self.s[at]:
            end += 1
        self.runs.append(_Run(len(self.parts), self.s[at], end - at, self.s[at - 1 : at] if at else "", self.s[end : end + 1]))
        return self._literal(at, end - at)

    def _bracket(self, at: int) -> int:
        if self.doc.notes and (m := re.compile(r"\[\^([^\]\s]+)\]").match(self.s, at)) and _folded(m[1]) in self.doc.notes:
            self.parts.append("")
            return m.end()
        self.brackets.append([len(self.parts), len(self.runs), at + 1, True, False])
        return self._literal(at)

    def _image(self, at: int) -> int:
        if not self.s.startswith("[", at + 1):
            return self._literal(at)
        self.brackets.append([len(self.parts), len(self.runs), at + 2, True, True])
        return self._literal(at, 2)

    def _close(self, at: int) -> int:
        if not self.brackets:
            return self._literal(at)
        part, below, begin, active, image = self.brackets.pop()
        end = self._linked(begin, at) if active else None
        if end is None:
            return self._literal(at)
        self.parts[part] = ""
        self._pair(below)
        if not image:
            # no link stands within a link
            for b in self.brackets:
                b[3] = b[3] and b[4]
        return end

    def _linked(self, begin: int, at: int) -> int | None:
        """The end of a link whose text ends at `at`, or None."""
        s = self.s
        if s.startswith("(", at + 1):
            k = _GAP.match(s, at + 2).end()
            if s.startswith(")", k):
                return k + 1
            if (after := _target(s, k)) is not None:
                gap = _GAP.match(s, after).end()
                title = _TITLE.match(s, gap) if gap > after else None
                k = _GAP.match(s, title.end()).end() if title else gap
                if s.startswith(")", k):
                    return k + 1
        m = _LABEL.match(s, at + 1)
        if m and m[1].strip():
            return m.end() if _folded(m[1]) in self.doc.labels else None
        return (at + 3 if m and not m[1] else at + 1) if at - begin <= 999 and _folded(s[begin:at]) in self.doc.labels else None

    def _pair(self, below: int) -> None:
        """Pair closing runs with the nearest opening ones above `below`; paired delimiters leave the text."""
        runs, k = self.runs[below:], 0
        del self.runs[below:]
        bottom: dict[tuple, int] = {}  # of a kind of closer: below this place nothing pairs with it
        live = list(range(len(runs)))
        while k < len(live):
            closer = runs[live[k]]
            if not closer.closes:
                k += 1
                continue
            kind = (closer.char, closer.opens, closer.size % 3 if closer.char != "~" else closer.size)
            j = k - 1
            while j >= 0 and live[j] >= bottom.get(kind, 0) and not runs[live[j]].pairs(closer):
                j -= 1
            if j < 0 or live[j] < bottom.get(kind, 0):
                bottom[kind] = live[k]
                if not closer.opens:
                    live.pop(k)
                else:
                    k += 1
                continue
            opener = runs[live[j]]
            n = closer.size if closer.char == "~" else 2 if min(opener.left, closer.left) > 1 else 1
            for run in (opener, closer):
                run.left -= n
                self.parts[run.part] = run.char * run.left
            del live[j + 1 : k]
            k = j + 1
            if not opener.left:
                live.pop(j)
                k -= 1
            if not closer.left:
                live.pop(k)


_STEPS = {"\\": "_backslash", "\n": "_newline", "`": "_backtick", "<": "_angle", "&": "_entity", "*": "_delimiter", "_": "_delimiter", "~": "_delimiter", "[": "_bracket", "!": "_image", "]": "_close"}


def without_frontmatter(text: str) -> str:
    """Without a leading block between lines of three dashes; white space may stand before it."""
    bare = text.lstrip(WHITE)
    if not bare.startswith("---") or (end := bare.find("\n---", 3)) < 0:
        return text
    return bare[end + 4 :].removeprefix("\n")


def prose_of(text: str) -> str:
    """Text outside code, headings and HTML. A paragraph's end and a line's end become one blank; cells of a table and items of
    a tight list have none between them. Alternative texts of images and texts of links stay."""
    doc, out = Document(without_frontmatter(text), notes=True), []
    for b, tight in doc.leaves():
        if b.kind == "para":
            out.append(doc.plain("\n".join(b.lines)) + ("" if tight else " "))
        elif b.kind == "table":
            width = len(_cells(b.lines[0]))
            out += [doc.plain(c) for row in b.lines for c in _cells(row)[:width]]
    return "".join(out)


def headings_of(text: str) -> list[dict]:
    """[{level, text}]: with inline code; the lines of a heading of several stand together without a blank, and there are
    no footnotes in this reading."""
    doc = Document(without_frontmatter(text))
    return [{"level": b.info, "text": doc.plain("\n".join(b.lines), code=True, gap="")} for b, _ in doc.leaves() if b.kind == "heading"]


def table_spans(text: str) -> list[tuple[int, int]]:
    """Where the tables of a text begin and end, in characters: from the header to the end of the last row."""
    spans = [b.info for b, _ in Document(text).leaves() if b.kind == "table"] if "|" in text else []
    return [(head_end - len(header), end) for (header, head_end), end in spans]


def table_ranges_of(text: str) -> list[dict]:
    """`table_spans` in bytes."""
    out, at, size = [], 0, 0
    for a, b in table_spans(text):
        start = size + len(text[at:a].encode())
        at, size = b, start + len(text[a:b].encode())
        out.append({"start": start, "end": size})
    return out
