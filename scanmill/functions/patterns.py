"""Regular expressions for tokens, in two dialects.

`spark` patterns are for Java's engine.  Every loop in them is possessive, which
keeps matching iterative (no stack growth on a million-letter token) and linear.
`re2` patterns say the same for linear-time engines, which have neither possessive
loops nor look-behind and need neither.
"""

from __future__ import annotations

# Unicode word-break classes (UAX #29 and Unicode Line_Break data).
_HAN = r"\x{2E80}-\x{2FD5}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
_HIRAGANA = r"\x{3041}-\x{3096}\x{309D}-\x{309F}"
_KATAKANA = r"\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
_SOUTH_EAST_ASIAN = (
    r"\x{0E01}-\x{0E3A}\x{0E40}-\x{0E4E}\x{0E81}-\x{0ECD}\x{0EDC}-\x{0EDF}"
    r"\x{1000}-\x{103F}\x{1050}-\x{108F}\x{1780}-\x{17D3}"
)
_EXTEND = r"[\p{M}\x{00AD}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
_LETTER = rf"[^\P{{L}}{_HAN}{_HIRAGANA}{_KATAKANA}{_SOUTH_EAST_ASIAN}]"
_MID_NUM_LET = r".'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
_MID_LETTER = rf"[:\x{{00B7}}\x{{0387}}\x{{05F4}}\x{{2027}}\x{{FE13}}\x{{FE55}}\x{{FF1A}}{_MID_NUM_LET}]"
_MID_NUMBER = (
    r"[,;\x{037E}\x{0589}\x{060C}\x{060D}\x{066C}\x{07F8}\x{2044}\x{FE10}\x{FE14}"
    rf"\x{{FE50}}\x{{FE54}}\x{{FF0C}}\x{{FF1B}}{_MID_NUM_LET}]"
)

# Shortcut for the bulk of the text: a run of plain letters and digits, up to
# characters that end a word in any case (joiners count only before one of those).
# Classes within Latin-1 are bit sets in Java, one lookup a character.
_PLAIN = r"[a-z0-9\xDF-\xF6\xF8-\xFF]"
_END = r"[\x09-\x0D !-&(-+\-/<-@\[-\^`{-~]"
_PLAIN_WORD = rf"{_PLAIN}++(?=[.,:;']*+(?:{_END}|\z))"
# No token starts at ASCII punctuation, blanks or controls.
_NOT_A_START = r"(?![\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])"


def token_pattern(dialect: str = "spark", shortcut: bool = True) -> str:
    """UAX #29 words of lower-cased text: letters, numbers, katakana runs, single
    ideographs.  `shortcut` changes the speed (of Java's engine), not the result."""
    p = _possessive(dialect)
    letter = _LETTER
    if dialect == "spark":
        # ASCII first: the union is tested left to right.
        letter = rf"[a-z{_LETTER}]"

    def run(unit: str, joiner: str) -> str:
        unit_run = rf"(?:{unit}+{p}{_EXTEND}*{p})+{p}"
        return rf"{unit_run}(?:{joiner}{_EXTEND}*{p}{unit_run})*{p}"

    letters = run(letter, _MID_LETTER)
    digits = run(r"\p{Nd}", _MID_NUMBER)
    katakana = rf"(?:[{_KATAKANA}]+{p}{_EXTEND}*{p})+{p}"
    segment = rf"(?:(?:{letters}|{digits})+{p}|{katakana})"
    lead = rf"(?:(?<!\p{{Pc}})\p{{Pc}}++)?+" if dialect == "spark" else r"\p{Pc}*"
    word = rf"{lead}{segment}(?:\p{{Pc}}+{p}{segment})*{p}\p{{Pc}}*{p}"
    full = (
        rf"{word}|[{_SOUTH_EAST_ASIAN}]+{p}"
        rf"|[{_HAN}]{_EXTEND}*{p}|[{_HIRAGANA}]{_EXTEND}*{p}"
    )
    if dialect == "re2" or not shortcut:
        return full
    return rf"{_PLAIN_WORD}|{_NOT_A_START}(?:{full})"


def _possessive(dialect: str) -> str:
    if dialect not in ("spark", "re2"):
        raise ValueError(f"unknown regex dialect: {dialect!r}")
    return "+" if dialect == "spark" else ""
