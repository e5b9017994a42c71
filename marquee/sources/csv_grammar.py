"""Error-recovering recursive-descent grammar for comma separated records.

    file    = record *( EOL record )
    record  = field *( "," field )
    field   = quoted / plain
    quoted  = DQUOTE *( any char but DQUOTE / DQUOTE DQUOTE ) DQUOTE     ; may hold line breaks
    plain   = *( any char but DQUOTE, ",", CR, LF )
    EOL     = CRLF / LF / CR

A record that breaks the grammar gives located syntax errors; the parser resumes at the next *validated
record-start anchor*: a line start from which a whole record of the expected width parses and whose first field
passes ``anchor``. Python is used because located errors and resumption need a parser's state; Spark's own reader
offers neither. It runs over Arrow batches, a record at a time, so no file has to fit into one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_PLAIN = re.compile(r'[^",\r\n]*')
_EOL = re.compile(r"\r\n|\n|\r")
_LINE_START = re.compile(r"(?:\r\n|\n|\r)(?!\Z)")

UNTERMINATED = "unterminated_quote"
AFTER_QUOTE = "text_after_closing_quote"
IN_PLAIN = "quote_in_plain_field"
EXTRA_LINE = "line_break_in_plain_field"


@dataclass
class SyntaxIssue:
    """What broke, where: offset into the text, physical line (from 1) and field number (from 0)."""

    code: str
    offset: int
    line: int
    field: int


@dataclass
class ParsedRecord:
    """fields of one record, the physical line it starts on, and its syntax errors (empty: well formed)."""

    fields: list[str]
    line: int
    start: int
    end: int
    issues: list[SyntaxIssue] = field(default_factory=list)


class RecordParser:
    """Recursive descent over one text. width and anchor say what a validated record start looks like."""

    def __init__(self, text: str, width: int | None = None, anchor: Callable[[str], bool] | None = None):
        self.text, self.at, self.width = text, 0, width
        self.anchor = anchor or (lambda first: True)
        self.line, self._line_at = 1, 0

    def _line_of(self, offset: int) -> int:
        self.line += len(_EOL.findall(self.text, self._line_at, offset)) if offset > self._line_at else 0
        self._line_at = max(self._line_at, offset)
        return self.line

    def line_at(self, offset: int) -> int:
        """The physical line of an offset, without moving on."""
        return self.line + len(_EOL.findall(self.text, self._line_at, offset))

    def file(self) -> Iterator[ParsedRecord]:
        """Every record of the text, broken ones included."""
        while self.at < len(self.text):
            yield self.record()

    def record(self) -> ParsedRecord:
        start, fields = self.at, []
        line = self._line_of(start)
        while True:
            begin = self.at
            value, code = self.field()
            fields.append(value)
            if code:
                # a stray quote may have run over good records: anchors are sought from where the field began
                issue = SyntaxIssue(code, self.at, self.line_at(self.at), len(fields) - 1)
                self.at = self.recover(begin)
                return ParsedRecord(fields, line, start, self.at, [issue])
            if self.text.startswith(",", self.at):
                self.at += 1
                continue
            eol = _EOL.match(self.text, self.at)
            self.at = eol.end() if eol else len(self.text)
            return ParsedRecord(fields, line, start, self.at)

    def field(self) -> tuple[str, str | None]:
        return self.quoted() if self.text.startswith('"', self.at) else self.plain()

    def quoted(self) -> tuple[str, str | None]:
        m = _QUOTED.match(self.text, self.at)
        if not m:
            rest = self.text[self.at + 1 :]
            return rest, UNTERMINATED
        self.at = m.end()
        value = m.group(1).replace('""', '"')
        return value, None if self.at_boundary() else AFTER_QUOTE

    def plain(self) -> tuple[str, str | None]:
        m = _PLAIN.match(self.text, self.at)
        self.at = m.end()
        return m.group(0), None if self.at_boundary() else IN_PLAIN

    def at_boundary(self) -> bool:
        return self.at >= len(self.text) or self.text[self.at] in ",\r\n"

    def recover(self, offset: int) -> int:
        """The first validated record start after offset, else the end of the text."""
        for m in _LINE_START.finditer(self.text, offset):
            if self.valid_start(m.end()):
                return m.end()
        return len(self.text)

    def valid_start(self, offset: int) -> bool:
        saved = self.at, self.line, self._line_at
        self.at, n, first = offset, 0, ""
        try:
            while True:
                value, code = self.field()
                if code:
                    return False
                first = value if not n else first
                n += 1
                if not self.text.startswith(",", self.at):
                    break
                self.at += 1
            return (self.width is None or n == self.width) and self.anchor(first)
        finally:
            self.at, self.line, self._line_at = saved


def parse_file(text: str, width: int | None = None, anchor: Callable[[str], bool] | None = None) -> list[ParsedRecord]:
    """All records of a whole file's text; one leading byte-order mark is dropped."""
    return list(RecordParser(text.removeprefix("﻿"), width, anchor).file())


def parse_one(text: str, width: int | None = None) -> ParsedRecord:
    """The one record that an upstream reader cut out. A CR or line end at its end is allowed; a second record in
    it is a syntax error (a line break outside quotes)."""
    body = text.removeprefix("﻿")
    parser = RecordParser(body, width)
    if not body:
        return ParsedRecord([""], 1, 0, 0)
    first = parser.record()
    if not first.issues and parser.at < len(body):
        first.issues.append(SyntaxIssue(EXTRA_LINE, parser.at, parser._line_of(parser.at), len(first.fields)))
    return first
