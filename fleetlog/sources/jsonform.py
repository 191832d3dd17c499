"""Whether bytes are a JSON document, block by block: what is kept is the open brackets and an unfinished token."""

from __future__ import annotations

import codecs
import re

MOST_DEPTH = 1 << 20  # deeper documents are no tables
MOST_SCALAR = 4096  # bytes of a number
SPACE = re.compile(rb"[ \t\n\r]*")
PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
ESCAPE = re.compile(rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
SCALAR = re.compile(rb"[-+.0-9A-Za-z]*")
VALUE = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


class JsonRecogniser:
    """Takes blocks by ``feed``; ``complete`` says whether what came so far is one JSON value."""

    def __init__(self) -> None:
        self.open = bytearray()
        self.wants = "value"  # or: first (value or "]"), key, first key (or "}"), colon, more (comma or end), end
        self.in_string = self.is_key = False
        self.rest = b""
        self.decoder = codecs.getincrementaldecoder("utf-8")("strict")
        self.wrong = False

    def feed(self, block: bytes, last: bool = False) -> bool:
        """False as soon as no JSON document starts with what came so far."""
        try:
            self.decoder.decode(block, last)
        except UnicodeDecodeError:
            self.wrong = True
        if not self.wrong:
            data = self.rest + block
            at = self.read(data, last)
            self.wrong = at is None
            self.rest = data[at:] if at is not None else b""
        return not self.wrong

    @property
    def complete(self) -> bool:
        return not self.wrong and not self.rest.strip(b" \t\n\r") and self.wants == "end" and not self.in_string

    def ended(self) -> None:
        self.wants = "more" if self.open else "end"

    def read(self, data: bytes, last: bool) -> int | None:
        """How much of ``data`` was taken, or None if it is wrong."""
        at = 0
        while True:
            if self.in_string:
                at = PLAIN.match(data, at).end()
                if at == len(data):
                    return at
                if data[at] == 0x22:
                    self.in_string, at = False, at + 1
                    if self.is_key:
                        self.wants = "colon"
                    else:
                        self.ended()
                elif escape := ESCAPE.match(data, at):
                    at = escape.end()
                else:
                    unfinished = data[at] == 0x5C and len(data) - at < 6 and re.fullmatch(rb"\\(?:u[0-9a-fA-F]{0,3})?", data[at:])
                    return at if unfinished and not last else None
                continue
            at = SPACE.match(data, at).end()
            if at == len(data):
                return at
            c, wants = data[at], self.wants
            if wants == "end":
                return None
            if c == 0x22 and wants in ("value", "first", "key", "first key"):
                self.in_string, self.is_key, at = True, wants in ("key", "first key"), at + 1
            elif c in b"{[" and wants in ("value", "first"):
                if len(self.open) == MOST_DEPTH:
                    return None
                self.open.append(c)
                self.wants, at = "first key" if c == 0x7B else "first", at + 1
            elif (c == 0x7D and wants in ("first key", "more") and self.open[-1:] == b"{") or (c == 0x5D and wants in ("first", "more") and self.open[-1:] == b"["):
                self.open.pop()
                self.ended()
                at += 1
            elif c == 0x3A and wants == "colon":
                self.wants, at = "value", at + 1
            elif c == 0x2C and wants == "more":
                self.wants, at = "key" if self.open[-1] == 0x7B else "value", at + 1
            elif wants in ("value", "first"):
                end = SCALAR.match(data, at).end()
                if end == len(data) and not last:
                    return at if end - at <= MOST_SCALAR else None
                if end - at > MOST_SCALAR or not VALUE.fullmatch(data, at, end):
                    return None
                at = end
                self.ended()
            else:
                return None
