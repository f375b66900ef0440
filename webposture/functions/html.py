"""Column helpers for HTML: the ``href`` values of a document.

The patterns read tags the way HTML tokenizers do.  Their loops are possessive, which Java runs
in place; greedy groups recurse and overflow the stack on hostile pages.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\n\f\r]"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)"
# Everything between a tag's name and its end: '>' ends a tag except in a quoted value.
_ATTRIBUTES = rf"(?:[^>=]++|={_WS}*+{_VALUE}?+)*+"
# Elements whose content is text, in which no tags are read.
_RAW_TEXT = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"

# Comments, <a> tags (group 1: attributes), raw-text elements, other tags, declarations.
_TOKEN = (
    r"(?is)<!--(?:>|->|.*?(?:--!?>|\z))"
    rf"|<a(?=[ \t\n\f\r/>])({_ATTRIBUTES})>"
    rf"|<({_RAW_TEXT})(?=[ \t\n\f\r/>]){_ATTRIBUTES}(?:\z|>.*?(?:</\2(?=[ \t\n\f\r/>])|\z))"
    r"|<plaintext(?=[ \t\n\f\r/>]).*+"
    rf"|</?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}(?:>|\z)"
    r"|<[!?/][^>]*+>?"
)
_NAME_END = r"(?=[ \t\n\f\r/>=]|\z)"
# The first attribute named href, group 1 its value with quotes.
_HREF = (
    rf"(?is)^(?:[ \t\n\f\r/]*+(?!href{_NAME_END})(?=[^ \t\n\f\r/>])=?[^ \t\n\f\r/>=]*+"
    rf"(?:{_WS}*+={_WS}*+{_VALUE}?+)?+)*+"
    rf"[ \t\n\f\r/]*+href{_NAME_END}(?:{_WS}*+={_WS}*+({_VALUE}))?"
)

_REFERENCE = (
    r"(?s)&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?"
    r"|&[A-Za-z][A-Za-z0-9]*+(?:;|(?![=A-Za-z0-9]))|[^&]+|&"
)
# What numeric references 128..159 stand for (windows-1252).
_C1 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def _character(code: Column) -> Column:
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    c1 = F.from_json(F.lit(json.dumps({str(k): v for k, v in _C1.items()})), "map<string,string>")
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("�"))
        .when(code.between(0x80, 0x9F), F.coalesce(F.try_element_at(c1, code.cast("string")), F.decode(utf32, "UTF-32")))
        .otherwise(F.decode(utf32, "UTF-32"))
    )


def decode_references(text: Column) -> Column:
    """Resolve character references by the rules for attribute values."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def resolve(token: Column) -> Column:
        hex_digits = F.regexp_extract(token, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
        digits = F.regexp_extract(token, r"^&#0*([0-9]*)", 1)
        return (
            F.when(token.rlike(r"^&#[xX]"), F.when(F.length(hex_digits) > 6, F.lit("�")).otherwise(
                _character(F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("bigint"))))
            .when(token.startswith("&#"), F.when(F.length(digits) > 7, F.lit("�")).otherwise(
                _character(F.concat(F.lit("0"), digits).cast("bigint"))))
            .when(token.startswith("&"), F.coalesce(F.try_element_at(named, F.substr(token, F.lit(2))), token))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, resolve), "")).otherwise(text)


def raw_hrefs(html: Column) -> Column:
    """The ``href`` values of the ``<a>`` tags in document order, as written, quotes included.

    The first ``href`` of a tag counts; tags without a value are left out.
    """
    has_anchor = F.contains(html, F.lit("<a")) | F.contains(html, F.lit("<A"))
    tags = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1))
    values = F.transform(F.filter(tags, lambda a: a != ""), lambda a: F.regexp_extract(a, _HREF, 1))
    return F.when(has_anchor, F.filter(values, lambda v: v != ""))


def unquoted(raw: Column) -> Column:
    """A value of ``raw_hrefs`` without quotes, character references as they are."""
    quoted = F.startswith(raw, F.lit('"')) | F.startswith(raw, F.lit("'"))
    return F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def href_value(raw: Column) -> Column:
    """A value of ``raw_hrefs`` without quotes, character references resolved."""
    return decode_references(unquoted(raw))
