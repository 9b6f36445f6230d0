"""Links and headings of CommonMark text, in source order, from one pass.

Blocks first (code, HTML, quotes, lists, headings, link definitions), then the
inline text of headings and paragraphs.  Link destinations are given as they
would be in HTML: escapes and entities resolved, other characters percent-encoded.
"""

from __future__ import annotations

import html
import re
from urllib.parse import quote

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
BLOCK_TAGS = (  # fixed values: the tag names of CommonMark's sixth kind of HTML block
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
TAG = r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"""
HTML_BLOCKS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(BLOCK_TAGS)})(?:\s|/?>|$)", re.I), None),
)
LONE_TAG = re.compile(rf" {{0,3}}(?:{TAG})\s*$")
INLINE_HTML = re.compile(rf"{TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
EMAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
ESCAPED = re.compile(r"""\\([!"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~-])|(&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});)""")
TITLE = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))"""
ANGLED = re.compile(r"<((?:\\.|[^<>\\\n])*)>")
LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){0,999})\]", re.S)
UNSAFE = re.compile(r"\s*(?:vbscript|javascript|file|data):", re.I)
SAFE_DATA = re.compile(r"\s*data:image/(?:gif|png|jpeg|webp);", re.I)


def _plain(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] or html.unescape(m[2]), text)


def href(destination: str) -> str:
    destination = re.sub(r"%(?![0-9A-Fa-f]{2})", "%25", destination)
    return quote(destination, safe=";/?:@&=+$,-_.!~*'()#%")


def _allowed(target: str) -> bool:
    return not UNSAFE.match(target) or bool(SAFE_DATA.match(target))


def _destination(text: str, at: int) -> tuple[str, int] | None:
    if m := ANGLED.match(text, at):
        return m[1], m.end()
    if at < len(text) and text[at] == "<":
        return None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] not in " \t\n":
            i += 2
            continue
        if c <= " " or c == "\x7f":
            break
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return None if depth else (text[at:i], i)


def _normal(label: str) -> str:
    return " ".join(label.split()).casefold().upper()


_TITLE_END = re.compile(rf"(?:[ \t]*\n[ \t]*|[ \t]+)({TITLE})[ \t]*(?:\n|$)", re.S)


def _definitions(text: str, known: dict[str, str]) -> str:
    """Take link definitions off a paragraph's beginning."""
    while m := LABEL.match(text):
        if text[m.end() : m.end() + 1] != ":" or not m[1].strip():
            return text
        at = re.compile(r"[ \t]*\n?[ \t]*").match(text, m.end() + 1).end()
        found = _destination(text, at)
        if found is None or (found[1] == at):
            return text
        end = found[1]
        if t := _TITLE_END.match(text, end):
            end = t.end()
        elif rest := re.compile(r"[ \t]*(?:\n|$)").match(text, end):
            end = rest.end()
        else:
            return text
        known.setdefault(_normal(m[1]), href(_plain(found[0])))
        text = text[end:]
    return text


def _detab(line: str) -> str:
    """Leading tabs as spaces."""
    if "\t" not in line:
        return line
    width = i = 0
    while i < len(line) and line[i] in " \t":
        width += 4 - width % 4 if line[i] == "\t" else 1
        i += 1
    return " " * width + line[i:]


def _interrupts(line: str) -> bool:
    """Does a line end a paragraph?"""
    if FENCE.match(line) or ATX.match(line) or RULE.match(line) or QUOTE.match(line):
        return True
    if (m := ITEM.match(line)) and line[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1"):
        return True
    return any(begin.match(line) for begin, _ in HTML_BLOCKS)


def _blocks(lines: list[str], known: dict[str, str], out: list[tuple[int, str]]) -> None:
    """(level, inline text) of headings and, at level 0, paragraphs."""
    paragraph: list[str] = []

    def close(level: int = 0) -> None:
        if paragraph:
            text = _definitions("\n".join(p.lstrip(" \t") for p in paragraph).rstrip(), known)
            if text.strip():
                out.append((level, text.strip()))
            elif level:
                out.append((0, ""))
            paragraph.clear()

    i, n = 0, len(lines)
    while i < n:
        line = _detab(lines[i])
        if not line.strip():
            close()
            i += 1
        elif line.startswith("    ") and not paragraph:
            i += 1
        elif m := FENCE.match(line):
            close()
            mark = m[1]
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            i += 1
            while i < n and not end.match(_detab(lines[i])):
                i += 1
            i += 1
        elif m := ATX.match(line):
            close()
            text = m[2] or ""
            out.append((len(m[1]), "" if re.fullmatch("#+", text) else text.strip()))
            i += 1
        elif paragraph and (m := SETEXT.match(line)):
            if _definitions("\n".join(p.lstrip(" \t") for p in paragraph).rstrip() + "\n", {}).strip():
                close(1 if m[1][0] == "=" else 2)
            else:
                close()
                paragraph.append(line)
            i += 1
        elif RULE.match(line):
            close()
            i += 1
        elif QUOTE.match(line):
            close()
            inner: list[str] = []
            while i < n:
                line = _detab(lines[i])
                if m := QUOTE.match(line):
                    inner.append(line[m.end() :])
                elif not line.strip() or not _open(inner) or _interrupts(line):
                    break
                else:
                    inner.append(line.lstrip())
                i += 1
            _blocks(inner, known, out)
        elif (m := ITEM.match(line)) and (not paragraph or _interrupts(line)):
            close()
            spaces = len(m[3])
            empty = not line[m.end() :].strip()
            indent = len(m[1]) + len(m[2]) + (1 if empty or spaces > 4 else spaces)
            inner = [line[indent:]]
            i += 1
            blank = False
            while i < n:
                line = _detab(lines[i])
                if not line.strip():
                    if empty and len(inner) == 1:
                        break
                    inner.append("")
                    blank = True
                elif len(line) - len(line.lstrip(" ")) >= indent:
                    inner.append(line[indent:])
                    blank = False
                elif blank or not _open(inner) or _interrupts(line) or ITEM.match(line):
                    break
                else:
                    inner.append(line.lstrip())
                i += 1
            _blocks(inner, known, out)
        elif (kind := next((e for b, e in HTML_BLOCKS if b.match(line)), 0)) != 0 or (not paragraph and LONE_TAG.match(line)):
            close()
            if kind:
                while i < n and not kind.search(lines[i]):
                    i += 1
                i += 1
            else:
                while i < n and lines[i].strip():
                    i += 1
        else:
            paragraph.append(line)
            i += 1
    close()


def _open(lines: list[str]) -> bool:
    """Do lines of a container end within a paragraph, so that a line without its marker goes on with it?"""
    if not lines or not lines[-1].strip():
        return False
    fence = None
    for x in lines:
        if fence is None and (m := FENCE.match(x)):
            fence = m[1]
        elif fence is not None and re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", x):
            fence = None
    last = lines[-1]
    while m := QUOTE.match(last) or ITEM.match(last):
        last = last[m.end() :]
    return fence is None and bool(last.strip()) and not ATX.match(last) and not RULE.match(last) and not (last.startswith("    ") and len(lines) == 1)


_SPECIAL = re.compile(r"[\\`<\[\]!]")


def _links(text: str, known: dict[str, str]) -> list[tuple[int, str]]:
    """(place, href) of every link that isn't an image."""
    if "[" not in text and "<" not in text:
        return []
    found: list[tuple[int, str]] = []
    openers: list[list] = []  # place, is an image, may be a link
    i = 0
    while m := _SPECIAL.search(text, i):
        i = m.start()
        c = m[0]
        if c == "\\":
            i += 2
        elif c == "`":
            ticks = re.compile("`+").match(text, i)[0]
            end = re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
            i = end.end() if end else i + len(ticks)
        elif c == "<":
            if a := AUTOLINK.match(text, i):
                if _allowed(a[1]):
                    found.append((i, href(a[1])))
                i = a.end()
            elif a := EMAIL.match(text, i):
                found.append((i, "mailto:" + href(a[1])))
                i = a.end()
            else:
                i = a.end() if (a := INLINE_HTML.match(text, i)) else i + 1
        elif c == "!":
            if text[i + 1 : i + 2] == "[":
                openers.append([i, True, True, i + 2])
                i += 2
            else:
                i += 1
        elif c == "[":
            openers.append([i, False, True, i + 1])
            i += 1
        else:
            i = _close(text, i, openers, known, found)
    return sorted(found)


def _close(text: str, i: int, openers: list[list], known: dict[str, str], found: list[tuple[int, str]]) -> int:
    if not openers:
        return i + 1
    place, image, active, inside = openers.pop()
    if not active:
        return i + 1
    target, end = None, i + 1
    if text[end : end + 1] == "(":
        target, after = _inline_target(text, end)
        end = after if target is not None else end
    if target is None:
        label = LABEL.match(text, i + 1)
        if label and label[1].strip():
            target, end = known.get(_normal(label[1])), label.end()
        else:
            if (target := known.get(_normal(text[inside:i]))) is not None and label:
                end = label.end()
        if target is None:
            return i + 1
    if not image:
        if not _allowed(target):
            return i + 1
        found.append((place, target))
        for o in openers:
            o[2] = o[2] and o[1]
    return end


_SPACE = re.compile(r"[ \t]*\n?[ \t]*")
_AFTER = re.compile(rf"(?:[ \t]+\n?|\n)[ \t]*({TITLE})", re.S)


def _inline_target(text: str, at: int) -> tuple[str | None, int]:
    """What stands in round brackets at ``at``."""
    begin = _SPACE.match(text, at + 1).end()
    dest = _destination(text, begin)
    if dest is None:
        return None, at
    end = dest[1]
    if title := _AFTER.match(text, end):
        end = title.end()
    end = _SPACE.match(text, end).end()
    if text[end : end + 1] != ")":
        return None, at
    return href(_plain(dest[0])), end + 1


def facts(body: str) -> tuple[list[str], list[tuple[int, str]]]:
    """(link targets, (level, text) of headings)."""
    known: dict[str, str] = {}
    leaves: list[tuple[int, str]] = []
    _blocks(body.replace("\x00", "\ufffd").split("\n"), known, leaves)
    links = [h for _, text in leaves for _, h in _links(text, known)]
    return links, [(level, text) for level, text in leaves if level]
