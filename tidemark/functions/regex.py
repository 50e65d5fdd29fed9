"""Translation of RE2 patterns to java.util.regex.

Spark evaluates ``rlike`` with Java's engine, whose dialect differs: what RE2 rejects (look-around, back-references,
possessive quantifiers) must be rejected here, and what both accept must mean the same.
"""

from __future__ import annotations

import re

WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_NO_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit"}
_SPACES = r"\t\n\f\r "
_MOST_REPEATS = 1000


class BadPattern(ValueError):
    """The pattern is not valid in the search language's dialect."""


class _FlagText(str):
    """Output that sets flags."""


class _Flags:
    def __init__(self, multiline: bool = False, ungreedy: bool = False):
        self.multiline, self.ungreedy = multiline, ungreedy

    def copy(self) -> _Flags:
        return _Flags(self.multiline, self.ungreedy)


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.at, self.out = pattern, 0, []
        self.names: dict[str, int] = {}
        self.groups = 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        s = self.peek(n)
        if len(s) < n:
            raise BadPattern("unexpected end")
        self.at += n
        return s

    def run(self) -> str:
        flags, stack, atom = _Flags(), [], False
        while self.at < len(self.p):
            c = self.take()
            if c == "(":
                opened, flags_inside = self.group(flags)
                if opened:
                    stack.append(flags)
                    flags = flags_inside
                else:
                    flags = flags_inside
                    continue  # setting flags is no atom: a quantifier after it is for what stands before
                atom = False
            elif c == ")":
                if not stack:
                    raise BadPattern("unexpected )")
                flags = stack.pop()
                self.out.append(")")
                atom = True
            elif c == "|":
                self.out.append("|")
                atom = False
            elif c in "*+?" or c == "{" and self.counted():
                if not atom:
                    raise BadPattern("nothing to repeat")
                self.quantifier(c, flags)
                atom = False
            elif c == "[":
                self.out.append(self.char_class())
                atom = True
            elif c == "\\":
                atom = self.escape()
            elif c == "^":
                self.out.append(r"(?:\A|(?<=\n))" if flags.multiline else r"\A")
                atom = True
            elif c == "$":
                self.out.append(r"(?=\n|\z)" if flags.multiline else r"\z")
                atom = True
            elif c == ".":
                self.out.append(".")
                atom = True
            else:
                self.out.append("\\" + c if c in "{}]" else c)
                atom = True
        if stack:
            raise BadPattern("missing )")
        return "(?d)" + "".join(self.out)

    def group(self, flags: _Flags) -> tuple[bool, _Flags]:
        """After an opening parenthesis: whether a group was opened, and the flags from here on."""
        if self.peek() != "?":
            self.groups += 1
            self.out.append("(")
            return True, flags.copy()
        self.take()
        named = re.match(r"P?<([^>]*)>", self.p[self.at :])
        if named:
            name = named[1]
            if not re.fullmatch(r"\w+", name):
                raise BadPattern("bad group name")
            self.at += named.end()
            self.groups += 1
            self.names.setdefault(name, self.groups)
            self.out.append("(")
            return True, flags.copy()
        m = re.match(r"([imsU]*)(-[imsU]+)?([:)])", self.p[self.at :])
        if not m:
            raise BadPattern("unsupported group")
        self.at += m.end()
        new = flags.copy()
        on, off = m[1], (m[2] or "")[1:]
        for letters, value in ((on, True), (off, False)):
            if "m" in letters:
                new.multiline = value
            if "U" in letters:
                new.ungreedy = value
        java = "".join(f for f in on if f in "is").replace("i", "iu")
        minus = "".join(f for f in off if f in "is").replace("i", "iu")
        text = java + ("-" + minus if minus else "")
        if m[3] == ":":
            self.out.append(f"(?{text}:")
            return True, new
        if text:
            self.out.append(_FlagText(f"(?{text})"))
        return False, new

    def counted(self) -> bool:
        return re.match(r"\d+(,\d*)?\}", self.p[self.at :]) is not None

    def quantifier(self, c: str, flags: _Flags) -> None:
        text = c
        if c == "{":
            m = re.match(r"(\d+)(?:,(\d*))?\}", self.p[self.at :])
            self.at += m.end()
            text += m[0]
            least, most = int(m[1]), int(m[2]) if m[2] else int(m[1])
            if least > _MOST_REPEATS or most > _MOST_REPEATS or m[2] and most < least:
                raise BadPattern("bad repeat count")
        lazy = self.peek() == "?"
        if lazy:
            self.take()
        if self.peek() and (self.peek() in "*+?" or self.peek() == "{" and re.match(r"\{\d+(,\d*)?\}", self.p[self.at :])):
            raise BadPattern("repeated repetition")
        at = len(self.out)
        while at and isinstance(self.out[at - 1], _FlagText):
            at -= 1
        self.out.insert(at, text + ("?" if lazy != flags.ungreedy else ""))

    def code_point(self, c: str) -> str | None:
        """Escapes of one code point, in or out of a class, as Java text."""
        if c in "01234567":
            digits = c + (re.match(r"[0-7]{0,2}", self.p[self.at :])[0])
            if c != "0" and len(digits) == 1:
                raise BadPattern("back-reference")
            self.at += len(digits) - 1
            return f"\\x{{{int(digits, 8):x}}}"
        if c == "x":
            m = re.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})", self.p[self.at :])
            if not m or int(m[1] or m[2], 16) > 0x10FFFF:
                raise BadPattern("bad code point")
            self.at += m.end()
            return f"\\x{{{m[1] or m[2]}}}"
        if c in "afnrt":
            return "\\" + c
        if c == "v":
            return r"\x0B"
        if ord(c) < 128 and not c.isalnum():
            return "\\" + c if c != " " else " "
        return None

    def property(self, c: str) -> str:
        name = self.take()
        if name == "{":
            end = self.p.find("}", self.at)
            if end < 0:
                raise BadPattern("bad property")
            name, self.at = self.p[self.at : end], end + 1
        if name.startswith("^"):
            name, c = name[1:], "P" if c == "p" else "p"
        if not re.fullmatch(r"[A-Za-z_]+", name):
            raise BadPattern("bad property")
        return f"\\{c}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def escape(self) -> bool:
        """After a backslash outside a class; whether it may be repeated."""
        c = self.take()
        simple = {"d": r"\d", "D": r"\D", "w": r"\w", "W": r"\W", "s": f"[{_SPACES}]", "S": f"[^{_SPACES}]", "b": _BOUNDARY, "B": _NO_BOUNDARY, "A": r"\A", "z": r"\z"}
        if c in simple:
            self.out.append(simple[c])
        elif c in "pP":
            self.out.append(self.property(c))
        elif c == "Q":
            end = self.p.find(r"\E", self.at)
            text, self.at = (self.p[self.at :], len(self.p)) if end < 0 else (self.p[self.at : end], end + 2)
            self.out.append("".join(re.sub(r"([^0-9A-Za-z_\s\x80-\U0010ffff])", r"\\\1", ch) for ch in text))
            return bool(text)
        else:
            java = self.code_point(c)
            if java is None:
                raise BadPattern(f"bad escape \\{c}")
            self.out.append(java)
        return True

    def char_class(self) -> str:
        out = "["
        if self.peek() == "^":
            out += self.take()
        first, last = True, None
        while True:
            c = self.take()
            if c == "]" and not first:
                return out + "]"
            first = False
            if c == "[":
                m = re.match(r":(\^?)(\w+):\]", self.p[self.at :])
                if m:
                    if m[2] == "word":
                        out += r"\W" if m[1] else r"\w"
                    elif m[2] == "space":
                        if m[1]:
                            raise BadPattern("unsupported class")
                        out += r"\t\n\x0B\f\r "
                    elif m[2] in _POSIX:
                        out += ("\\P" if m[1] else "\\p") + f"{{{_POSIX[m[2]]}}}"
                    else:
                        raise BadPattern("bad class name")
                    self.at += m.end()
                    last = None
                    continue
            one, wide = self.member(c)
            if not wide and self.peek() == "-" and self.peek(2) != "-]" and len(self.peek(2)) == 2:
                self.take()
                high, wide = self.member(self.take())
                if wide or self.value(high) < self.value(one):
                    raise BadPattern("bad range")
                out += f"{one}-{high}"
            else:
                out += one
            last = one
        return out

    def member(self, c: str) -> tuple[str, bool]:
        """A class member as Java text, and whether it stands for several characters."""
        if c != "\\":
            return ("\\" + c if c in "[]&^-~#" else c), False
        c = self.take()
        several = {"d": r"\d", "D": r"\D", "w": r"\w", "W": r"\W", "s": _SPACES, "S": r"\S\x0B"}
        if c in several:
            return several[c], True
        if c in "pP":
            return self.property(c), True
        java = self.code_point(c)
        if java is None:
            raise BadPattern(f"bad escape \\{c} in a class")
        return java, False

    @staticmethod
    def value(java: str) -> int:
        m = re.fullmatch(r"\\x\{?([0-9A-Fa-f]+)\}?", java)
        if m:
            return int(m[1], 16)
        return ord({"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\f": "\f", "\\a": "\a"}.get(java, java[-1]))


def to_java(pattern: str) -> str:
    """The Java pattern with the meaning that ``pattern`` has in RE2; :class:`BadPattern` if it has none."""
    return _Translator(pattern).run()


def group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of the named groups of a pattern."""
    t = _Translator(pattern)
    t.run()
    return t.names
