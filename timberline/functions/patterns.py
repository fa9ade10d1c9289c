"""Patterns in the syntax of the web's regular expressions, translated for Python and for Java."""

from __future__ import annotations

import hashlib
import re

#: White space and line ends as that syntax has them, for use inside a character class.
SPACE_CLASS = r"\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_LINE_END = r"[^\n\r\u2028\u2029]"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
NO_EDGE = r"(?:(?<![A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_]))"


QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")
#: Fixed value: seconds after which a users' pattern on one text counts as one that never ends.
LIMIT_S = 2.0


class PatternError(ValueError):
    """The pattern cannot be run here; the message says why."""


def _translate(pattern: str, flags: str, java: bool) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            if len(two) < 2:
                raise PatternError("a backslash ends the pattern")
            k = two[1]
            step = 2
            plain = {"d": "0-9", "w": "A-Za-z0-9_", "s": SPACE_CLASS}
            if k in plain:
                out.append(plain[k] if in_class else f"[{plain[k]}]")
            elif k in "DWS" and not in_class:
                out.append(f"[^{plain[k.lower()]}]")
            elif k in "DWS":
                raise PatternError(f"\\{k} inside a class is not supported")
            elif k in "bB" and not in_class:
                out.append(EDGE if k == "b" else NO_EDGE)
            elif k == "k":
                m = re.match(r"\\k<([A-Za-z_$][\w$]*)>", pattern[i:])
                if not m:
                    raise PatternError("\\k needs a name")
                out.append(rf"\k<{m[1]}>" if java else f"(?P={m[1]})")
                step = len(m[0])
            elif k == "u" and re.match(r"\\u[0-9A-Fa-f]{4}", pattern[i:]):
                out.append(re.escape(chr(int(pattern[i + 2 : i + 6], 16))))
                step = 6
            elif k == "x" and re.match(r"\\x[0-9A-Fa-f]{2}", pattern[i:]):
                out.append(pattern[i : i + 4])
                step = 4
            elif k in "tnrfv0":
                out.append({"v": r"\x0b", "0": r"\x00"}.get(k, two))
            elif k in "123456789":
                out.append(two)
            elif k.isalpha():
                raise PatternError(f"\\{k} is not supported")
            else:
                out.append("\\" + k if not k.isalnum() else k)
            i += step
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&~" else c)
        elif c == "[":
            if pattern[i : i + 3] == "[^]" or two == "[]":
                raise PatternError("empty classes are not supported")
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "{" and not QUANTIFIER.match(pattern, i):
            out.append(r"\{")
        elif c == ".":
            out.append(r"[\s\S]" if "s" in flags else NOT_LINE_END)
        elif c == "$" and "m" not in flags:
            out.append(r"\z" if java else r"\Z")
        elif c == "$":
            out.append(r"(?=[\n\r\u2028\u2029]|\z)" if java else r"(?=[\n\r\u2028\u2029]|\Z)")
        elif c == "^":
            out.append(r"(?:(?<=[\n\r\u2028\u2029])|\A)" if "m" in flags else r"\A")
        elif pattern[i : i + 3] == "(?<" and pattern[i + 3 : i + 4] not in ("=", "!"):
            m = re.match(r"\(\?<([A-Za-z_$][\w$]*)>", pattern[i:])
            if not m or java and re.search(r"[_$]", m[1]):
                raise PatternError("bad group name")
            out.append(f"(?<{m[1]}>" if java else f"(?P<{m[1]}>")
            i += len(m[0]) - 1
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("a class is not closed")
    return ("(?iu)" if java and "i" in flags else "(?i)" if "i" in flags else "") + "".join(out)


def python_source(pattern: str, flags: str = "") -> str:
    return _translate(pattern, flags, java=False)


def compile_python(pattern: str, flags: str = "") -> re.Pattern:
    try:
        return re.compile(python_source(pattern, flags))
    except re.error as e:
        raise PatternError(str(e)) from e


def user_patterns(sources) -> list:
    """Users' patterns (Python sources), compiled by an engine whose searches can be given up after a time."""
    import regex

    return [regex.compile(str(s)) for s in sources]


#: Digests of searches that were given up in this process, the last GIVEN_UP of them.
_given_up: dict[bytes, None] = {}
GIVEN_UP = 65_536


def _search_key(limit_s: float, of: tuple[str, ...]) -> bytes:
    return hashlib.blake2b(repr((limit_s, *of)).encode(), digest_size=16).digest()


def within(limit_s: float, search, *of: str):
    """The result of ``search`` (of a time limit). One given up is tried once more with four times the limit, so that a
    pause of the machine is not taken for a slow pattern; the second time it raises TimeoutError.

    ``of`` are what is done, the pattern and the text, where known: a process searches a text no further once it was given up with the
    same pattern and limit, so copies of a text cost no time."""
    if of and _given_up and _search_key(limit_s, of) in _given_up:
        raise TimeoutError("given up before")
    try:
        return search(limit_s)
    except TimeoutError:
        pass
    try:
        return search(4 * limit_s)
    except TimeoutError:
        if of:
            while len(_given_up) >= GIVEN_UP:
                del _given_up[next(iter(_given_up))]
            _given_up[_search_key(limit_s, of)] = None
        raise


class UserPattern(str):
    """A user's pattern, as Python source. ``java`` is the same for the JVM, where it is safe there (see ``java_safe``);
    ``literal`` a text that every match holds, in any case of its letters if ``caseless``."""

    java: str | None = None
    literal: str = ""
    caseless: bool = False


def checked(pattern: str, flags: str = "") -> UserPattern:
    """A user's pattern; PatternError where it is none."""
    out = UserPattern(compile_python(pattern, flags).pattern)
    out.literal, out.caseless = required_literal(pattern, "i" in flags), "i" in flags
    if java_safe(pattern):
        try:
            out.java = java_source(pattern, flags)
        except PatternError:  # a group's name that Java does not allow
            pass
    return out


#: Repeats of open length that a pattern may have on the JVM: each adds a factor of the line's length to the worst case.
MAX_OPEN = 2
TOKEN = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\k<[^>]*>|\\.|\[(?:\\.|[^\]\\])*\]|\(\?(?:[:=!]|<[=!]|<[^>]*>)|[*+?]\??|\{[0-9]+(?:,[0-9]*)?\}\??|.", re.S)


def _tokens(pattern: str) -> list[str]:
    return TOKEN.findall(pattern)


def _quantifier(token: str) -> bool:
    return token[0] in "*+?" or bool(re.match(r"\{[0-9]", token)) and token.rstrip("?")[-1] == "}"


def java_safe(pattern: str) -> bool:
    """Whether an engine without a time limit may search for a pattern: its worst case is a small power of the text's length.

    It has no back reference and no look-around, repeats no group that holds a repeat, a choice or nothing, and has at most
    MAX_OPEN repeats of open length.
    """
    loose, opened = [False], 0  # of each open group: whether it must not be repeated
    tokens = _tokens(pattern)
    for i, t in enumerate(tokens):
        follows = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t.startswith("(?") and t not in ("(?:",) and not re.fullmatch(r"\(\?<[^=!].*>", t) or re.fullmatch(r"\\(?:[1-9]|k.*)", t, re.S):
            return False
        if t.startswith("("):
            loose.append(follows == ")")
        elif t == ")":
            if len(loose) == 1:
                return False
            inner = loose.pop()
            again = _quantifier(follows) and follows[0] != "?" if follows else False
            if again and inner:
                return False
            loose[-1] = loose[-1] or inner or bool(follows and _quantifier(follows))
        elif t == "|":
            loose[-1] = True
        elif _quantifier(t):
            loose[-1] = True
            m = re.match(r"\{([0-9]+)(,?)([0-9]*)\}", t)
            opened += t[0] in "*+" or bool(m and m[2] and m[3] != m[1])
    return len(loose) == 1 and opened <= MAX_OPEN


def required_literal(pattern: str, caseless: bool) -> str:
    """The longest run of plain characters that stands in every match, outside groups and choices; empty if there is none.

    Without regard to case only characters count that have two cases at most.
    """
    best = now = ""
    depth, tokens = 0, _tokens(pattern)
    for i, t in enumerate(tokens):
        follows = tokens[i + 1] if i + 1 < len(tokens) else ""
        plain = t[1] if len(t) == 2 and t[0] == "\\" and not t[1].isalnum() else t if len(t) == 1 and t not in "^$.|()[]*+?{}\\" else ""
        if t == "|" and not depth:
            return ""
        depth += t.startswith("(") - (t == ")")
        fits = plain and not depth and (not caseless or plain.isascii() and plain not in "iIkKsS")
        if fits and not (follows and _quantifier(follows)):
            now += plain
            best = max(best, now, key=len)
        else:
            now = ""
    return best


def java_source(pattern: str, flags: str = "") -> str:
    return _translate(pattern, flags, java=True)


def escape(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text)
