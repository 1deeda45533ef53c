"""Parsers of raw files into segments ``(text, section_heading, page_number)``; standard library only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from html.parser import HTMLParser

Segment = tuple[str, str | None, int | None]


class ExtractionError(ValueError):
    """A file can't be read as what it claims to be, or holds nothing (``no_text``)."""


def normalize(text: str) -> str:
    """The text normalisation of ``functions.text.normalize_text`` on one string."""
    text = re.sub(r"\r\n?", "\n", text.replace("\x00", ""))
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n").strip()


def _decode(content: bytes, codec: str = "utf-8") -> str:
    try:
        return content.decode(codec)
    except UnicodeDecodeError as error:
        raise ExtractionError("extraction: not UTF-8") from error


def parse_text(content: bytes) -> list[Segment]:
    """One segment, also of an empty file; a byte-order mark is dropped."""
    return [(normalize(_decode(content, "utf-8-sig")), None, None)]


class _Headings:
    """Stack of headings; a heading ends those of its level and below."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []

    def push(self, level: int, text: str) -> str:
        self.stack = [h for h in self.stack if h[0] < level] + [(level, text)]
        return " > ".join(t for _, t in self.stack)


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:[A-Za-z/!?])")


def inline_text(source: str) -> str:
    """Plain text of inline Markdown: emphasis marks, links' targets, images, tags and escapes go; code
    spans and link texts stay."""
    kept: list[str] = []

    def hold(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    source = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: hold(re.sub(r"^ (.*[^ ].*) $", r"\1", m[2].replace("\n", " "))), source, flags=re.S)
    source = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), source)
    source = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", source)
    source = re.sub(r"<((?:https?|mailto|ftp):[^>\s]*)>", r"\1", source)
    source = re.sub(r"</?[A-Za-z][^>]*>|<!--.*?-->", "", source, flags=re.S)
    source = re.sub(r"\[([^\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)", r"\1", source)
    source = re.sub(r"(\*\*\*|\*\*|\*)(?=\S)(.+?)(?<=\S)\1", r"\2", source, flags=re.S)
    source = re.sub(r"(?<!\w)(___|__|_)(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", source, flags=re.S)
    source = re.sub(r" *\n *", "\n", re.sub(r"(?: {2,}|\\)\n", "\n", source))
    source = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], source)
    from html import unescape

    return unescape(source).strip()


def parse_markdown(content: bytes) -> list[Segment]:
    """Sections between headings; blocks joined by blank lines; code kept as it is; raw HTML dropped."""
    lines = _decode(content).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    headings, current = _Headings(), None
    blocks: list[str] = []
    paragraph: list[str] = []
    found: list[Segment] = []

    def end_paragraph() -> None:
        if paragraph:
            text = inline_text("\n".join(line.strip() for line in paragraph))
            paragraph.clear()
            if text:
                blocks.append(text)

    def end_section() -> None:
        end_paragraph()
        text = "\n\n".join(blocks)
        blocks.clear()
        if text.strip():
            found.append((normalize(text), current, None))

    at = 0
    while at < len(lines):
        line = re.sub(r"^(?: {0,3}> ?)+", "", lines[at])
        fence = _FENCE.match(line)
        if fence:
            end_paragraph()
            closing = re.compile(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            code: list[str] = []
            at += 1
            while at < len(lines) and not closing.match(lines[at]):
                code.append(re.sub(rf"^ {{0,{len(fence[1])}}}", "", lines[at]))
                at += 1
            text = "\n".join(code).rstrip("\n")
            if text:
                blocks.append(text)
        elif not line.strip():
            end_paragraph()
        elif atx := _ATX.match(line):
            end_section()
            current = headings.push(len(atx[1]), inline_text(atx[2] or ""))
        elif paragraph and (under := _SETEXT.match(line)):
            title = inline_text("\n".join(p.strip() for p in paragraph))
            paragraph.clear()
            end_section()
            current = headings.push(1 if under[1][0] == "=" else 2, title)
        elif _RULE.match(line):
            end_paragraph()
        elif not paragraph and re.match(r"(?: {4}|\t)", line):
            code = []
            while at < len(lines) and (re.match(r"(?: {4}|\t)", lines[at]) or not lines[at].strip()):
                code.append(re.sub(r"^(?: {4}|\t)", "", lines[at]))
                at += 1
            at -= 1
            text = "\n".join(code).rstrip("\n ")
            if text:
                blocks.append(text)
        elif not paragraph and _HTML_BLOCK.match(line) and not re.match(r" {0,3}<(?:https?|mailto):", line):
            while at + 1 < len(lines) and lines[at + 1].strip():
                at += 1
        elif item := _ITEM.match(line):
            end_paragraph()
            rest = line[item.end() :]
            while inner := _ITEM.match(rest):
                rest = rest[inner.end() :]
            if rest.strip():
                paragraph.append(rest)
        else:
            paragraph.append(re.sub(r"^\s*(?:[-+*]|\d{1,9}[.)])\s+", "", line) if not paragraph and re.match(r"\s+(?:[-+*]|\d{1,9}[.)])\s", line) else line)
        at += 1
    end_section()
    if not found:
        raise ExtractionError("no_text")
    return found


class _Page(HTMLParser):
    """Collects the text of content tags that lie in no other content tag, and the headings."""

    content = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre"))
    noise = frozenset(("script", "style", "noscript", "head", "template"))
    void = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.items: list[tuple[str, list[str], bool]] = []
        self.has_body = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.void:
            return
        if tag == "body":
            self.has_body = True
        if tag in self.content and not any(t in self.content for t in self.open) and not self._muted():
            self.items.append((tag, [], "body" in self.open))
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:  # what was left open inside ends with it
            while self.open.pop() != tag:
                pass

    def _muted(self) -> bool:
        return any(t in self.noise for t in self.open)

    def handle_data(self, data: str) -> None:
        if data.strip() and not self._muted() and self.items and any(t in self.content for t in self.open):
            self.items[-1][1].append(data.strip())


def parse_html(content: bytes) -> list[Segment]:
    """Sections between headings of a page; only headings, paragraphs, list items and preformatted text
    count, the outermost where they are nested. A tag that is never closed holds what follows it."""
    page = _Page()
    page.feed(_decode(content))
    page.close()
    headings, current = _Headings(), None
    found: list[Segment] = []
    lines: list[str] = []
    for tag, parts, in_body in page.items:
        text = " ".join(parts)
        if not text or (page.has_body and not in_body):
            continue
        if tag[0] == "h":
            if lines:
                found.append((normalize("\n\n".join(lines)), current, None))
                lines = []
            current = headings.push(int(tag[1]), text)
        else:
            lines.append(text)
    if lines:
        found.append((normalize("\n\n".join(lines)), current, None))
    if not found:
        raise ExtractionError("no_text")
    return found


_PDF_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


def _pdf_string(raw: bytes) -> str:
    out, i = bytearray(), 0
    simple = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while i < len(raw):
        c = raw[i : i + 1]
        if c == b"\\":
            n = raw[i + 1 : i + 2]
            octal = re.match(rb"[0-7]{1,3}", raw[i + 1 :])
            if octal:
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            out += simple.get(n, n if n not in (b"\n", b"\r") else b"")
            i += 2
            continue
        out += c
        i += 1
    text = bytes(out)
    return text[2:].decode("utf-16-be", "replace") if text[:2] == b"\xfe\xff" else text.decode("cp1252", "replace")


_PDF_SHOW = re.compile(rb"\((?P<s>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)\s*(?P<op>Tj|'|\")|\[(?P<a>(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<])*)\]\s*TJ|<(?P<h>[0-9A-Fa-f\s]*)>\s*Tj|(?P<move>T\*|\bT[dDm]\b|\bBT\b)", re.S)


def _pdf_text(stream: bytes) -> str:
    out: list[str] = []
    for m in _PDF_SHOW.finditer(stream):
        if m["move"]:
            if out and out[-1] != "\n":
                out.append("\n")
        elif m["s"] is not None:
            if m["op"] != b"Tj" and out:
                out.append("\n")
            out.append(_pdf_string(m["s"]))
        elif m["h"] is not None:
            out.append(_pdf_string(bytes.fromhex(re.sub(rb"\s", b"", m["h"]).decode().ljust(2, "0"))))
        else:
            for s in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)", m["a"]):
                if s[1] is not None:
                    out.append(_pdf_string(s[1]))
                elif float(s[2]) < -200:
                    out.append(" ")
    return "".join(out)


def parse_pdf(content: bytes) -> list[Segment]:
    """One segment for each page with text, with its true page number. Reads plain and Flate streams;
    encrypted and broken files are errors."""
    if not content.lstrip().startswith(b"%PDF") or b"/Encrypt" in content:
        raise ExtractionError("extraction: not a readable PDF")
    objects = {int(m[1]): m[3] for m in _PDF_OBJECT.finditer(content)}
    for body in list(objects.values()):  # objects packed into streams
        if b"/ObjStm" in body and (stream := _PDF_STREAM.search(body)):
            try:
                data = zlib.decompress(stream[1])
            except zlib.error:
                continue
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, data[:first].split()))
            for i in range(0, len(numbers) - 1, 2):
                end = numbers[i + 3] if i + 3 < len(numbers) else len(data) - first
                objects.setdefault(numbers[i], data[first + numbers[i + 1] : first + end])
    pages = [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    kids = [int(k) for body in objects.values() if re.search(rb"/Type\s*/Pages\b", body) for group in re.findall(rb"/Kids\s*\[(.*?)\]", body, re.S) for k in re.findall(rb"(\d+)\s+\d+\s+R", group)]
    ordered = [k for k in kids if k in pages] or sorted(pages)
    if not ordered:
        raise ExtractionError("extraction: no pages")
    found: list[Segment] = []
    for number, page in enumerate(ordered, 1):
        parts = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", objects[page], re.S)
        texts = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", (parts[1] or parts[2]) if parts else b""):
            body = objects.get(int(ref), b"")
            stream = _PDF_STREAM.search(body)
            if not stream:
                continue
            data = stream[1]
            if b"FlateDecode" in body:
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error as error:
                    raise ExtractionError("extraction: broken stream") from error
            texts.append(_pdf_text(data))
        text = normalize("\n".join(texts))
        if text:
            found.append((text, None, number))
    if not found:
        raise ExtractionError("no_text")
    return found


PARSERS: dict[str, Callable[[bytes], list[Segment]]] = {"txt": parse_text, "markdown": parse_markdown, "html": parse_html, "pdf": parse_pdf}


def parse(kind: str | None, content: bytes | None) -> tuple[list[Segment], str | None]:
    """``(segments, error class)`` of one file; never raises."""
    if kind not in PARSERS:
        return [], "unsupported_type"
    try:
        return PARSERS[kind](content or b""), None
    except ExtractionError as error:
        return [], "no_text" if str(error) == "no_text" else "extraction"
    except Exception:  # a file that breaks its parser is a bad file
        return [], "extraction"
