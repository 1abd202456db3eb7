"""Text functions as column expressions: folding, tokens, lines, snippets."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@cache
def _fold_table() -> tuple[str, str]:
    """(letters with a diacritic, their base letters): every lower-case letter that decomposes canonically to one base letter and marks."""
    marked, base = [], []
    for code in range(0xC0, 0x1F00 + 0x100):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and len(parts[0].encode()) < 4 and unicodedata.category(c) in ("Ll", "Lu", "Lo") and all(unicodedata.category(p) == "Mn" for p in parts[1:]) and parts[0] < "Ͱ":
            marked.append(c)
            base.append(parts[0])
    return "".join(marked), "".join(base)


_MARKS = "[\\u0300-\\u036F]"


def fold(text: Column | str) -> Column:
    """Lower case without diacritics (Latin letters, composed or decomposed)."""
    letters, base = _fold_table()
    lower = F.lower(F.col(text) if isinstance(text, str) else text)
    # most texts are plain: the table, which ends before U+2000, is used only where there is something to fold
    plain = F.translate(F.regexp_replace(lower, _MARKS, ""), letters, base)
    return F.when(lower.rlike("[\\u00C0-\\u1FFF]"), plain).otherwise(lower)


def fold_text(text: str) -> str:
    """fold() for a query on the driver."""
    table = dict(zip(*_fold_table(), strict=True))
    return "".join(table.get(c, c) for c in text.lower() if not "̀" <= c <= "ͯ")


def tokens(text: Column | str) -> Column:
    """The terms of a text, in order: runs of letters, numbers and private-use characters of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


class _Letters(dict):
    """What str.translate() makes of a lower-case character: folded if it belongs to a token, a space if not; filled as characters are met."""

    def __init__(self):
        super().__init__(zip(map(ord, _fold_table()[0]), _fold_table()[1], strict=True))
        self.update(dict.fromkeys(range(0x300, 0x370)))  # marks go

    def __missing__(self, code: int) -> int:
        kind = unicodedata.category(chr(code))
        self[code] = place = code if kind[0] in "LN" or kind == "Co" else 0x20
        return place


@cache
def _letters() -> _Letters:
    return _Letters()


def query_tokens(text: str) -> list[str]:
    """tokens() for a query on the driver."""
    return [t for t in text.lower().translate(_letters()).split(" ") if t]


def lines(text: Column | str) -> Column:
    r"""The lines of a text: cut at \n or \r\n, without an empty line after the last one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(text, "\\r?\\n\\z", ""), "\\r?\\n", -1)


def strip(text: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike("(?U)\\S")


def snippet(content: Column | str, size: int = 200) -> Column:
    """The first `size` characters, stripped, with `...` if the text has more than `size` bytes."""
    content = F.col(content) if isinstance(content, str) else content
    short = strip(F.substring(content, 1, size))
    return F.when(F.octet_length(content) > size, F.concat(short, F.lit("..."))).otherwise(short)
