"""Character classes for patterns: Unicode words, spaces and word edges.

Java's ``\\w`` and ``\\b`` are ASCII unless a flag is set, and with the flag they count combining
marks as word characters. The classes below are explicit instead: letters, numbers, underscore.
"""

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
TRIMMED = r"[\t-\r\x20\x85\p{Z}]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
