"""Text of JSON values, redaction, references between files, kinds of files, quotes as evidence."""

from __future__ import annotations

import difflib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys whose values are never kept, compared without case, _ and -.
SENSITIVE = ("token", "authorization", "password", "secret", "accesstoken", "refreshtoken", "apikey", "clientsecret")
REDACTED = "[Redacted]"
#: Fixed value: characters of a file above which no diff is made.
MOST_DIFF = 1 << 20
#: The shortest quote that proves anything, and the widest range it may cite.
QUOTE_MIN, RANGE_MAX = 2, 50

#: Attributes that name another file; characters of a URL's scheme; blanks.
FILE_ATTRIBUTES = ("src", "href", "poster")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SCHEME = _LETTERS + "0123456789+.-"
_BLANKS = " \t\n\x0b\f\r"

_FOLDED = str.maketrans("", "", "_-")
#: An escaped NUL whose backslash is not itself escaped.
_NUL = re.compile(r"(?<!\\)((?:\\\\)*)\\u0000")


def _without_secrets(pairs: list[tuple]) -> dict:
    return {k: REDACTED if k.translate(_FOLDED).lower() in SENSITIVE else v for k, v in pairs}


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


@F.pandas_udf(StringType())
def redact(raw: pd.Series) -> pd.Series:
    """JSON text with the values of sensitive keys replaced at any depth and without NUL characters;
    what is not JSON, and null, becomes null.  Equal texts of a batch are decoded once.

    The decoder hands over every object as it closes, inner ones first, so no walk is needed.
    """
    decoder = json.JSONDecoder(object_pairs_hook=_without_secrets, parse_constant=_no_number)
    encoder = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))
    known: dict[str, str | None] = {}
    for text in raw.dropna().unique():
        try:
            known[text] = encoder.encode(decoder.decode(_NUL.sub(r"\1", text)))
        except ValueError:
            known[text] = None
    return raw.map(known.get)


def _leaves(value) -> list[str]:
    if isinstance(value, str):
        return [value] if value else []
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [json.dumps(value)]
    if isinstance(value, list):
        return [leaf for v in value for leaf in _leaves(v)]
    return [leaf for k in sorted(value, key=str.encode) for leaf in _leaves(value[k])]


@F.pandas_udf(StringType())
def json_text(raw: pd.Series) -> pd.Series:
    """Strings and numbers of a JSON value, arrays in order and objects by key, a line each."""

    def one(text):
        try:
            return None if text is None else "\n".join(_leaves(json.loads(text)))
        except ValueError:
            return None

    return raw.map(one)


def line_id(native: Column, stable: Column) -> Column:
    """A line's own UUID in lower case, else the name-based UUID (version 5) of its stable JSON text."""
    name = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), stable.cast("binary")))
    variant = F.translate(F.substring(name, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")  # its two high bits are 10
    cut = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("5"), F.substring(name, 14, 3)), F.concat(variant, F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    named = F.when(stable.isNotNull(), F.concat_ws("-", *cut))
    shape = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.when(native.rlike(shape), F.lower(native)).otherwise(named)


def _named_by_attribute(text: Column) -> Column:
    """Values of the file attributes.  Cut at every quote mark, a text has a value behind each piece that
    ends in a name and an equals sign, if a quote mark closes it."""
    pieces = F.split(text, "[\"']")

    def opens(piece: Column) -> Column:
        bare = F.rtrim(piece, F.lit(_BLANKS))
        name = F.lower(F.rtrim(F.left(bare, F.length(bare) - 1), F.lit(_BLANKS)))
        ends = F.lit(False)
        for own in FILE_ATTRIBUTES:
            before = F.substring(F.right(name, F.lit(len(own) + 1)), 1, 1)
            alone = (name == own) | ~before.rlike(r"[\w:-]")
            ends |= name.endswith(own) & alone
        return bare.endswith("=") & ends

    closed = F.greatest(F.size(pieces) - 2, F.lit(0))
    before, value = F.slice(pieces, F.lit(1), closed), F.slice(pieces, F.lit(2), closed)
    both = F.filter(F.arrays_zip(before.alias("b"), value.alias("v")), lambda x: opens(x["b"]))
    return F.transform(both, lambda x: x["v"])


def _linked_in_markdown(text: Column) -> Column:
    """Targets of Markdown links and images.  Behind each ``](`` that a bracket was opened for stands a
    target, up to a blank or the parenthesis that closes the link."""
    pieces = F.split(text, r"\]\(")
    later = F.slice(pieces, F.lit(2), F.size(pieces))
    earlier = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    both = F.arrays_zip(earlier.alias("b"), later.alias("v"))
    opened = F.filter(both, lambda x: F.contains(F.substring_index(x["b"], "]", -1), F.lit("[")))

    def target(piece: Column) -> Column:
        run = F.element_at(F.split(F.ltrim(piece, F.lit(_BLANKS)), r"\s", 2), 1)
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("open"), F.lit(False).alias("end"))

        def step(s: Column, part: Column) -> Column:
            depth = s["open"] + F.length(part) - F.length(F.replace(part, F.lit("(")))
            goes_on = F.struct(
                F.concat(s["t"], part, F.when(depth > 0, ")").otherwise("")).alias("t"),
                F.greatest(depth - 1, F.lit(0)).alias("open"), (depth == 0).alias("end"),
            )
            return F.when(s["end"], s).otherwise(goes_on)

        return F.aggregate(F.split(run, r"\)"), start, step, lambda s: s["t"])

    return F.transform(opened, lambda x: target(x["v"]))


def _is_local(reference: Column) -> Column:
    scheme = F.lower(F.substring_index(reference, ":", 1))
    absolute = (
        F.contains(reference, F.lit(":"))
        & (F.translate(scheme, _SCHEME, "") == "")
        & (F.translate(F.left(scheme, F.lit(1)), _LETTERS, "") == "")
        & (scheme != "")
    )
    return ~(absolute | reference.startswith("//") | reference.startswith("#"))


def references(content: Column) -> Column:
    """Local files that an HTML or Markdown text refers to, decoded, without query and fragment, each once
    in order of first mention (HTML first)."""
    text = F.coalesce(content, F.lit(""))
    raw = F.filter(F.concat(_named_by_attribute(text), _linked_in_markdown(text)), _is_local)
    local = F.transform(raw, lambda r: F.substring_index(F.substring_index(r, "#", 1), "?", 1))
    # a plus sign is itself in a path
    decoded = F.transform(local, lambda r: F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r))
    return F.array_distinct(F.filter(decoded, lambda r: r != ""))


def is_binary(content: Column) -> Column:
    """Whether bytes hold a NUL or are not UTF-8."""
    return F.contains(content, F.lit(b"\0")) | ~F.is_valid_utf8(content.cast("string"))


def artifact_kind(path: Column, binary: Column) -> Column:
    """code, docs or media of a file by its name; binary files are media."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    media = ending.isin("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "pdf", "mp3", "mp4", "mov", "wav")
    return F.when(binary | media, "media").when(ending.isin("md", "mdx", "txt", "rst", "adoc", "html", "htm"), "docs").otherwise("code")


@F.pandas_udf(StringType())
def unified_diff(base: pd.Series, current: pd.Series, path: pd.Series) -> pd.Series:
    """Unified diff of a file against its base; null where either is null or larger than MOST_DIFF."""

    def one(a, b, p):
        if a is None or b is None or max(len(a), len(b)) > MOST_DIFF:
            return None
        lines = difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{p}", f"b/{p}")
        return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in lines)

    return pd.Series([one(*x) for x in zip(base, current, path, strict=True)], dtype=object)


def _cited(head: Column) -> Column:
    """Struct (from, to) of one id, or of two with ``to`` or a dash between them; null for anything else."""
    ids = F.regexp_extract_all(head, F.lit("msg-[0-9]+"), F.lit(0))
    rest = F.trim(F.regexp_replace(head, "msg-[0-9]+", ""), F.lit(_BLANKS))
    fits = F.when(F.size(ids) == 1, rest == "").otherwise((F.size(ids) == 2) & rest.isin("to", "-", "–", "—"))
    both = F.struct(F.try_element_at(ids, F.lit(1)).alias("from"), F.try_element_at(ids, F.lit(-1)).alias("to"))
    return F.when(fits & head.startswith("msg-"), both)


def _bare(quote: Column) -> Column:
    """A quote without the pair of quote marks around it."""
    text = F.trim(quote, F.lit(_BLANKS))
    paired = F.left(text, F.lit(1)).isin('"', "“") & F.right(text, F.lit(1)).isin('"', "”") & (F.length(text) > 1)
    return F.when(paired, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def evidence(line: Column) -> Column:
    """Struct (from, to, quote, why) of a line ``msg-1 to msg-2 — "quote" — why``; null if it is none.

    A mask of the same length shows where the line's dashes, quote marks and blanks are.  With two long
    dashes that stand free, the quote is all between the first and the last of them.  Else it is what
    stands in quote marks, up to the first mark that a dash follows, and any dash will do.
    """
    text = F.trim(line, F.lit(_BLANKS))
    mask = F.translate(text, "–\t\n\x0b\f\r“”", '—     ""')
    n, free = F.length(text), F.lit(" — ")

    def field(begin: Column, end: Column) -> Column:
        return F.trim(F.substring(text, begin, F.greatest(end - begin, F.lit(0))), F.lit(_BLANKS))

    one = F.locate(" — ", mask, 1)
    two = one + 2 + F.instr(F.substring(mask, one + 3, n), " — ")
    # a range may itself be written with a free dash
    ranged = (two > one + 2) & field(one + 3, two).rlike("^msg-[0-9]+$")
    first = F.when(ranged, two).otherwise(one)
    last = n - F.instr(F.reverse(mask), " — ") - 1
    wide_ids = _cited(field(F.lit(1), first))
    wide = F.struct(
        wide_ids["from"].alias("from"), wide_ids["to"].alias("to"),
        _bare(field(first + 3, last)).alias("quote"), field(last + 3, n + 1).alias("why"),
    )
    is_wide = F.contains(mask, free) & (first < last) & (field(first + 3, last) != "") & wide_ids.isNotNull()

    mark = F.instr(mask, '"')
    head = field(F.lit(1), mark)
    loose_ids = _cited(F.rtrim(F.left(head, F.length(head) - 1), F.lit(_BLANKS)))
    # pieces between marks; the quote ends before the first later piece that starts with a dash
    pieces = F.transform(
        F.split(F.substring(mask, mark + 1, n), '"'),
        lambda x, i: F.struct(F.length(x).alias("n"), ((i > 0) & F.ltrim(x).rlike("^[—-]")).alias("ends")),
    )
    start = F.struct((mark + 1).alias("at"), F.lit(False).alias("end"))
    closing = F.aggregate(pieces, start, lambda s, x: F.when(s["end"] | x["ends"], F.struct(s["at"].alias("at"), F.lit(True).alias("end"))).otherwise(
        F.struct((s["at"] + x["n"] + 1).alias("at"), F.lit(False).alias("end"))))
    after = F.ltrim(field(closing["at"], n + 1), F.lit(_BLANKS + "—–-"))
    loose = F.struct(
        loose_ids["from"].alias("from"), loose_ids["to"].alias("to"),
        field(mark + 1, closing["at"] - 1).alias("quote"), after.alias("why"),
    )
    is_loose = (mark > 0) & F.right(head, F.lit(1)).isin("-", "–", "—") & closing["end"] & (after != "") & loose_ids.isNotNull()
    return F.when(is_wide, wide).when(is_loose, loose)


def squash(text: Column) -> Column:
    """Text as quotes are compared: JSON escapes undone, quote marks gone, blanks single, lower case."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[nrt]", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r'\\(["\\/])', "$1"), '["“”]', "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def quote_pieces(quote: Column) -> Column:
    """Squashed pieces of a quote between ellipses, without empty ones."""
    return F.filter(F.transform(F.split(quote, r"…|\.\.\."), squash), lambda p: p != "")
