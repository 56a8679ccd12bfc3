"""Column expressions that turn markup into tokens.

Everything but Unicode decomposition, entity decoding and nested markup is a built-in expression;
those run on Arrow batches. Patterns use only syntax that Java and RE2 share.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MIN_TOKEN = 4

# (pattern, replacement); `$1` is the first group. Applied to lower-case text in order, the
# first list before and the second after nested constructs are taken out by `strip_nested`.
WIKI_TAG_RULES = [
    (r"(?s)<!--.*?-->", " "),
    (r"<ref[^>]*/>", " "),
    (r"(?s)<ref[^>]*>.*?</ref>", " "),
    (r"(?s)<math[^>]*>.*?</math>", " "),
    (r"(?s)<gallery[^>]*>.*?</gallery>", " "),
]
WIKI_TEXT_RULES = [
    (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
    (r"<[^>]+>", " "),
    (r"&#?[a-z0-9]+;", " "),
    (r"'{2,}", ""),
]
HIDDEN_LINKS = ("category:", "file:", "image:")
TEMPLATE, TABLE, LINK, BRACE = "template", "table", "link", "brace"

# Elements whose removal joins the words around them; all others separate words.
INLINE_TAGS = (
    "a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "s", "small", "span",
    "strike", "strong", "sub", "sup", "tt", "u",
)
HTML_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<head[^>]*>.*?</head>", " "),
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?is)<ref[^>]*/>", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^>]*)?/?>", ""),
    (r"<[^>]+>", " "),
]
HTML_TEXT_RULES = [
    (r"\{\{[^\}]+\}\}", ""),
    (r"\[\[Category:([^\]]+)\]\]", "$1"),
]


SLICE_ROWS = 128  # rows of a batch that are Python strings at once


@F.arrow_udf(StringType())
def decompose(text: pa.Array) -> pa.Array:
    """Unicode canonical decomposition (NFD)."""
    return pc.utf8_normalize(text, form="NFD")


@F.arrow_udf(StringType())
def decode_and_decompose(text: pa.Array) -> pa.Array:
    """Character references to characters, then NFD."""
    return _by_slices(_decoded, text, pa.string())


def _decoded(text: pa.Array) -> pa.Array:
    decoded = [html.unescape(t) if t and "&" in t else t for t in text.to_pylist()]
    return pc.utf8_normalize(pa.array(decoded, pa.string()), form="NFD")


def _by_slices(fn: Callable[[pa.Array], pa.Array], text: pa.Array, kind: pa.DataType) -> pa.Array:
    """``fn`` of a batch, whose texts are Python strings only a few rows at a time."""
    parts = [fn(text.slice(at, SLICE_ROWS)) for at in range(0, len(text), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def apply_rules(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


_MARK = re.compile(r"\{+|\}+|\[\[|\]\]|\|\}")


def strip_nested(text: str) -> tuple[str, str | None]:
    """Text without templates, tables and hidden links, other links replaced by their label.

    One pass with a stack of open constructs, so they nest to any depth. Closing marks without
    an opening one are text. The second value names the outermost construct left open.
    """
    stack: list[tuple[str, list[str]]] = [("", [])]
    at, end = 0, len(text)

    def close(kind: str) -> None:
        """Close ``kind``; what is open inside it goes with it."""
        while stack[-1][0] != kind:
            stack.pop()
        content = "".join(stack.pop()[1])
        if kind == LINK and not content.lstrip(" :").startswith(HIDDEN_LINKS):
            stack[-1][1].append(content.partition("|")[2] if "|" in content else content)
        elif kind != BRACE:
            stack[-1][1].append(" ")

    def is_open(kind: str) -> bool:
        """Whether ``kind`` is the innermost construct but for links and single braces."""
        for k, _ in reversed(stack):
            if k not in (LINK, BRACE) or k == kind:
                return k == kind
        return False

    while (found := _MARK.search(text, at)) is not None:
        stack[-1][1].append(text[at : found.start()])
        at, mark = found.end(), found.group()
        inside = stack[-1][0]
        if mark == "[[":
            stack.append((LINK, []))
        elif mark == "]]":
            if inside == LINK:
                close(LINK)
            else:
                stack[-1][1].append(mark)
        elif mark[0] == "{":
            if len(mark) == 1 and text[at : at + 1] == "|":
                stack.append((TABLE, []))
                at += 1
                continue
            for _ in range(len(mark) // 2):
                stack.append((TEMPLATE, []))
            if len(mark) % 2:
                if len(stack) > 1:
                    stack.append((BRACE, []))
                else:
                    stack[-1][1].append("{")
        elif mark == "|}":
            if is_open(TABLE) and not text.startswith("|}}", found.start()):
                close(TABLE)
            elif is_open(TABLE) and not any(k == TEMPLATE for k, _ in stack):
                close(TABLE)
            else:
                stack[-1][1].append("|")
                at = found.start() + 1  # the brace may close a template
        else:
            left = len(mark)
            while left:
                if stack[-1][0] == BRACE and left != 2:
                    close(BRACE)
                    left -= 1
                elif left > 1 and is_open(TEMPLATE):
                    close(TEMPLATE)
                    left -= 2
                elif stack[-1][0] == BRACE:
                    close(BRACE)
                    left -= 1
                else:
                    stack[-1][1].append("}" * left)
                    left = 0
    stack[-1][1].append(text[at:end])
    left_open = next((k for k, _ in stack if k in (TEMPLATE, TABLE, LINK)), None)
    return "".join(part for _, parts in stack for part in parts), left_open


@F.arrow_udf(StructType([StructField("plain", StringType()), StructField("reason", StringType())]))
def strip_constructs(text: pa.Array) -> pa.Array:
    """`strip_nested` of each text; the reason is why a text can't be stripped, or null."""
    return _by_slices(_stripped, text, pa.struct([("plain", pa.string()), ("reason", pa.string())]))


def _stripped(text: pa.Array) -> pa.Array:
    plain, reason = zip(*[(None, "no text") if t is None else strip_nested(t) for t in text.to_pylist()])
    return pa.StructArray.from_arrays([pa.array(plain, pa.string()), pa.array(reason, pa.string())], ["plain", "reason"])


def word_tokens(text: Column) -> Column:
    """Runs of word characters with at least `MIN_TOKEN` characters."""
    return F.regexp_extract_all(text, F.lit(rf"\w{{{MIN_TOKEN},}}"), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
