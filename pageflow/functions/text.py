"""Text expressions shared by the page operators. All are native; lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, U+FEFF included; Java's own class is ASCII only.
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: What stands for the text of a failed page.
ERROR_MARK = "[ERROR: OCR Failed"
#: What stands for a page of which no source has text.
NOT_FOUND = "[未検出]"
BEGIN = r"### -- Begin Page (\d+)"
BEGIN_STRICT = r"### -- Begin Page (\d+).*? --"
END = r"### -- End.*? --"
CONTINUES = "(Continuation)"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
#: Characters that end a sentence, and forms that start a line of their own.
SENTENCE_END = r"[。．！？!?：:；;」』）)】\]]\z"
LINE_START = r"^(?:[・●◯■□◆◇※▶▷▼▽▲△★☆]|[-*#]|[0-9]+[.)．、]|\([0-9０-９一二三四五六七八九十]+\))"


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{WS}+", ""), rf"{WS}++\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}++\z", "")


def normalize_ws(text: Column) -> Column:
    """Line ends to ``\\n``, runs of blank, tab and U+3000 to one blank, three line ends or more to two, trimmed. Null gives ''."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")
    return trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\x{3000}]+", " "), "\n{3,}", "\n\n"))


def normalize_digits(text: Column) -> Column:
    """Full-width digits to ASCII."""
    return F.translate(text, FULL_DIGITS, DIGITS)


def full_width_digits(text: Column) -> Column:
    """How many full-width digits a text holds."""
    return F.regexp_count(text, F.lit("[０-９]"))


def is_error(text: Column) -> Column:
    return text.contains(ERROR_MARK)


def body_of(content: Column) -> Column:
    """A page's text without markers and error placeholders."""
    for pattern in (BEGIN_STRICT, END, r"\[ERROR: OCR Failed.*?\]"):
        content = F.regexp_replace(content, pattern, "")
    return trim(content)


def strip_legacy(content: Column) -> Column:
    """Without ``=-- Page … --=`` lines of the old form; those that continue also take the white space around them."""
    content = F.regexp_replace(content, rf"(?m){WS}*^=-- Page .*?\(Continuation\).*?--={WS}*", "")
    return F.regexp_replace(content, rf"(?m)^=-- Page .*?--={WS}*\n?", "")


def reflow(text: Column) -> Column:
    """Join hard-wrapped lines.

    A line starts anew if the line before is blank or ends a sentence, or if it has the form of a list item or
    heading; blank lines become one. What is joined last ends like the line before, so each line needs only the
    one before it. Null stays null.
    """
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1), trim)
    # Both arrays are made once a text: a lambda that looked into ``lines`` would split and trim the text again for every line.
    before = F.concat(F.array(F.lit("")), F.slice(lines, 1, F.size(lines) - 1))
    placed = F.zip_with(lines, before, lambda line, b: F.struct(line.alias("line"), b.alias("before")))
    full = F.filter(placed, lambda x: x["line"] != "")
    glue = lambda x: F.when(x["before"] == "", "\n\n").when(x["before"].rlike(SENTENCE_END) | x["line"].rlike(LINE_START), "\n").otherwise("")
    return F.array_join(F.transform(full, lambda x, i: F.concat(F.when(i == 0, "").otherwise(glue(x)), x["line"])), "")


def is_json(text: Column) -> Column:
    """Whether a text as a whole is one JSON value; null gives false.

    Spark's JSON functions stop after the first value and pass over what follows. So the text is read in brackets, where it must be the only
    element, and in braces, which a text that closes the bracket itself fails.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options)
    held = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, _bad string", options)
    return F.coalesce((F.size(listed) == 1) & held["_bad"].isNull(), F.lit(False))


def head_tail_text(text: Column, limit: int = 12_000) -> Column:
    """A normalised text, or its first and last halves of ``limit`` characters around a mark if it is longer."""
    text = normalize_ws(text)
    head, tail = trim(F.left(text, F.lit(limit // 2))), trim(F.right(text, F.lit(limit - limit // 2)))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat_ws("\n\n", head, F.lit("[中略]"), tail))
