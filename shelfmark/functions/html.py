"""HTML tokens and character references as expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# An attribute is a name, or a name and a value: in double quotes, in single ones, bare, or missing before the tag's end.
_VALUE = r"""(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>|\z)))?+"""
_ATTRIBUTE = r"[\s/]*+([^\s/>=][^\s/>=]*+)" + _VALUE
_REST = "(?:" + _ATTRIBUTE.replace("([^", "(?:[^", 1).replace('("', '(?:"').replace(r"|\z", "") + r")*+[\s/]*+>"
#: Elements whose content is text, whatever it looks like.
_RAW = "script|style|xmp|iframe|noembed|noframes|textarea|title"
#: One token after the other, as a tokenizer finds them; group 1 is what stands in an anchor's tag behind its name.
#: A tag that never ends takes the rest of the page.
_TOKENS = (
    rf"(?is)<a(?=[\s/>])({_REST})"
    r"|<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<({_RAW})(?=[\s/>]){_REST}.*?(?:(?=</\2[\s/>])|\z)"
    rf"|<plaintext(?=[\s/>]){_REST}.*+"
    rf"|</?[a-z][^\s/>]*+{_REST}"
    r"|</?[a-z].*+"
    r"|<[!?/][^>]*+(?:>|\z)"
)
#: What the numbers 128 to 159 stand for.
_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def anchors(html: Column) -> Column:
    """The attributes of each anchor's tag, in order; what stands in comments, scripts and the like is none."""
    return F.filter(F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(1)), lambda tag: tag != "")


def written(tag: Column, name: str) -> Column:
    """The first value of an attribute in what anchors gives, as it is written; null if there is none."""
    text = F.regexp_replace(tag, r">\z", "")
    names, values = (F.regexp_extract_all(text, F.lit("(?s)" + _ATTRIBUTE), F.lit(k)) for k in (1, 2))
    found = F.get(F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda a: F.lower(a["name"]) == name), F.lit(0))["value"]
    return F.regexp_replace(found, r"""(?s)^(["'])(.*)\1\z""", "$2")


def attribute(tag: Column, name: str) -> Column:
    """The same with references decoded."""
    return references(written(tag, name))


def _character(code: Column) -> Column:
    wrong = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
    return F.when(code.between(0x80, 0x9F), F.translate(char, "".join(map(chr, range(0x80, 0xA0))), _HIGH)).otherwise(char)


def references(text: Column) -> Column:
    """Character references of an attribute's value decoded: numbers, and names by HTML's own table. A name without
    a semicolon counts only if neither `=` nor a letter or digit follows."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # one constant, not thousands

    def piece(p: Column) -> Column:
        digits, hexes = F.regexp_extract(p, "^#0*([0-9]+)", 1), F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]+)", 1)
        code = F.when(digits != "", F.when(F.length(digits) < 8, digits.cast("long")).otherwise(0)).otherwise(F.when(F.length(hexes) < 7, F.conv(hexes, 16, 10).cast("long")).otherwise(0))
        number = F.concat(_character(code), F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))
        key = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*;?)", 1)
        follows = F.substr(p, F.length(key) + 1)
        named = F.when(~follows.startswith("="), table[key])
        as_it_is = F.concat(F.lit("&"), p)
        return F.when(p.rlike("^#(?:[0-9]|[xX][0-9a-fA-F])"), number).when(key != "", F.coalesce(F.concat(named, follows), as_it_is)).otherwise(as_it_is)

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(~text.contains("&"), text).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(rest, "")))
