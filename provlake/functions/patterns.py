"""Patterns of private data and the language guard, as regular expressions.

One alternation finds every span in a single pass: the leftmost match wins, and
on a tie the order of the alternatives gives the longest.  A text is searched only for
the kinds of which it holds a telling part.
"""

from __future__ import annotations

from provlake import vocab as V

_NOT_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
_B64 = "[A-Za-z0-9_-]"

# a block without its closing line runs to the end of the text
PRIVATE_KEY = (r"-----BEGIN[^\r\n]*?PRIVATE KEY[^\r\n]*?-----[\r\n](?s:.*?)"
               r"(?:-----END(?s:.*?)-----\n|-----(?=END)|\z)")

# Repeats are possessive, and a kind begins only where its run of characters begins (or where the last match ended), so
# one pass over a text of any shape is enough.
_PATH_CHAR = r"[^\"'<>|?*\n\r\t .,;)\]]"
# signs and single spaces belong to a path only when more of it follows; behind the space another component must
_PATH_JOINT = rf"(?:[.,;)\]]| (?=[^\\/ ]*+[\\/]))++(?={_PATH_CHAR})"
_PATH_REST = rf"(?:{_PATH_CHAR}++|{_PATH_JOINT})"
WINDOWS_PATH = (rf"(?:{_NOT_WORD_BEFORE}[A-Za-z]:[\\/]{_PATH_REST}++"
                rf"|\\\\(?:{_PATH_JOINT}{_PATH_CHAR}|{_PATH_CHAR}(?:{_PATH_CHAR}|{_PATH_JOINT}{_PATH_CHAR})){_PATH_REST}*+)")

# the run of domain characters must end in a dot and 2 to 24 letters; dots after it are left alone
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?:[A-Za-z0-9-]++|\.++(?=[A-Za-z0-9-]))++(?<=\.[A-Za-z]{{2,24}})")
JWT = rf"{_NOT_WORD_BEFORE}eyJ{_B64}++\.{_B64}{{4,}}+\.{_B64}{{4,}}+(?![A-Za-z0-9_.-])"


def token(prefix: str, tail: int) -> str:
    alphabet = "[A-Z0-9]" if prefix in V.UPPER_ONLY_TOKENS else _B64
    return rf"{_NOT_WORD_BEFORE}{prefix}{alphabet}{{{tail},}}+"


# (pattern, texts of which one occurs in every match), in the order that decides between matches with one start
KINDS = [(PRIVATE_KEY, ["PRIVATE KEY"]), (WINDOWS_PATH, [":\\", ":/", "\\\\"]), (EMAIL, ["@"]), (JWT, ["eyJ"]),
         *[(token(p, t), [p]) for p, t, _ in V.TOKEN_SHAPES]]

SENSITIVE_KEY = "|".join(V.SENSITIVE_KEYS)


def whole_word(word: str) -> str:
    return rf"(?<![a-z0-9_A-Z]){word}(?![a-z0-9_A-Z])"


FORBIDDEN = "|".join([whole_word("(?:" + "|".join(V.FORBIDDEN_WORDS) + ")")] + V.FORBIDDEN_PHRASES)
