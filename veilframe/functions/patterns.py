"""The detection patterns and their rewrite for the JDK regex engine.

Patterns are written once, in the RE2 dialect. ``to_jdk`` rewrites the four
constructs whose meaning differs on the JDK, so that both engines return the
same matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.tokens import check_type

# --- fixed values: patterns and scores (RE2 syntax) ---------------------------
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CREDIT_CARD = (
    r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))"
    r"[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,4}\b"
)
PHONE_US = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
PHONE_INTL = r"\b\+\d{1,3}[-.\s]?\d{4,14}\b"
IP_ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
API_KEY = (
    r"(?i)(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token)"
    r"""\s*[:=]\s*["']?([a-zA-Z0-9\-_]{20,})["']?"""
)
AWS_KEY = r"AKIA[0-9A-Z]{16}"

INJECTION_PATTERNS = (
    r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?|context)",
    r"(?i)disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"(?i)forget\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"(?i)you\s+are\s+now\s+(DAN|evil|unrestricted|unfiltered|jailbroken)",
    r"(?i)pretend\s+(you\s+are|to\s+be)\s+(a\s+)?(hacker|evil|malicious|unrestricted)",
    r"(?i)act\s+as\s+(if\s+)?(you\s+(have|had)\s+)?(no|zero)\s+(restrictions?|limitations?|filters?|rules?)",
    r"(?i)(reveal|show|print|display|output|repeat)\s+(your|the|system)\s+(system\s+)?(prompt|instructions?|rules?|configuration)",
    r"(?i)what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
    r"(?i)(base64|rot13|hex)\s*(encode|decode|encrypt|decrypt)\s+(the\s+)?(following|this)",
    r"(?i)(enter|enable|activate|switch\s+to)\s+(developer|debug|admin|maintenance|test)\s+mode",
    r"(?i)\[SYSTEM\]|\[INST\]|<<SYS>>|<\|im_start\|>|<\|system\|>",
)
# --- end of fixed values ------------------------------------------------------

WHITESPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def to_jdk(pattern: str) -> str:
    """Rewrite ``\\b``, ``\\s`` and ``(?i)`` to their RE2 meaning on the JDK."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
        elif two == r"\s":
            out.append(WHITESPACE if in_class else f"[{WHITESPACE}]")
            i += 2
        elif two == r"\b" and not in_class:
            out.append(_BOUNDARY)
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i += 1
    return "".join(out)


def edge_test(patterns: Sequence[Pattern]) -> list[str]:
    """A cheap regex that texts with a match of one of the patterns satisfy, if all begin at ``\\b``.

    A match's first character is one of ``first``, and no word character with another before it.
    """
    if not all(p.first and p.regex.startswith(r"\b") for p in patterns):
        return []
    return [f"[{''.join(p.first for p in patterns)}](?<![{_WORD}]{{2}})"]


@dataclass(frozen=True)
class Pattern:
    """One detection pattern.

    ``first`` lists the characters a match can start with: a one-character
    look-ahead that spares the engine the costly boundary test elsewhere.
    ``any_of`` lists literals of which a matching text must hold one; ``digits``
    says a match holds a digit. ``glue`` lists the characters that can stand
    right before white space inside a match, and ``never`` characters, none of
    them a letter, digit or underscore, that no match holds or tests for beside
    it; long texts are cut there. Without a stated ``glue`` they stay whole.
    """

    name: str
    type: str
    confidence: float
    regex: str
    first: str = ""
    any_of: tuple[str, ...] = ()
    glue: str | None = None
    never: str = ""
    luhn: bool = False
    digits: bool = False

    def __post_init__(self) -> None:
        check_type(self.type)

    @property
    def detector_name(self) -> str:
        return f"regex:{self.name}"

    @property
    def jdk(self) -> str:
        if self.name == "email":
            # Start only at the left edge of a run of local-part characters, or
            # where the previous match ended: same matches, linear time.
            run = r"[a-zA-Z0-9._%+\-]"
            return rf"(?:\G|(?<!{run}))" + self.regex
        body = to_jdk(self.regex)
        if not self.first:
            return body
        flags = "(?iu)" if body.startswith("(?iu)") else ""
        return f"{flags}(?=[{self.first}]){body[len(flags):]}"

    def gate(self, text: Column) -> Column | None:
        """False only where the pattern cannot match; None when there is no such test."""
        tests = [F.contains(text, F.lit(s)) for s in self.any_of]
        return reduce(or_, tests) if tests else None


#: In no match of the patterns below.
NEVER = ",;<>{}|[]!?"

PATTERNS = (
    Pattern("email", "email", 0.95, EMAIL, any_of=("@",), glue="", never=NEVER),
    Pattern("ssn", "ssn", 0.98, SSN, first="0-9", glue="", never=NEVER, digits=True),
    Pattern(
        "credit_card", "credit_card", 0.90, CREDIT_CARD,
        first="3-6", glue="0123456789", never=NEVER, luhn=True, digits=True,
    ),
    Pattern(
        "phone_us", "phone", 0.85, PHONE_US,
        first="0-9+(", glue="0123456789)", never=NEVER, digits=True,
    ),
    Pattern(
        "phone_intl", "phone", 0.80, PHONE_INTL,
        first="+", any_of=("+",), glue="0123456789", never=NEVER, digits=True,
    ),
    Pattern(
        "ip_address", "ip_address", 0.75, IP_ADDRESS,
        first="0-9", glue="", never=NEVER, digits=True,
    ),
    Pattern(
        "api_key_generic", "api_key", 0.90, API_KEY,
        first="as", any_of=("=", ":"), glue="yYnN:=", never=NEVER,
    ),
    Pattern("aws_key", "api_key", 0.98, AWS_KEY, any_of=("AKIA",), glue="", never=NEVER),
)
