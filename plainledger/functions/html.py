"""HTML and text columns: entities, visible text, titles, cleanup, hashes, chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainledger.functions.values import col

# A reference: a number, or a name that may lack its semicolon.
REFERENCE = r"&(?:#\d{1,7};|#[xX][0-9A-Fa-f]{1,6};|[A-Za-z][A-Za-z0-9]{0,31};?)"
CLOSED_REFERENCE = REFERENCE.replace(";?", ";")
# Names that most pages use, looked at before the whole table.
FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "copy;", "mdash;", "ndash;")
# Names that HTML knows without a semicolon, the longest first.
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)


# Every blank a text may hold, hard and exotic ones included.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def decode_entities(text: Column | str, bare_names: bool = True) -> Column:
    """Numeric references and all names of HTML 5, in one pass.

    A name without a semicolon counts as far as HTML knows it so: of `&notit;` the
    longest known start, `&not`, is decoded; without `bare_names` it stays as it is,
    like anything else.
    """
    pattern = REFERENCE if bare_names else CLOSED_REFERENCE
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def one(part: Column, reference: Column) -> Column:
        exact = F.try_element_at(names, F.substring(reference, F.lit(2), F.length(reference)))
        named = F.when(exact.isNotNull(), exact)
        if bare_names:
            bare = F.regexp_extract(reference, "^&(" + "|".join(BARE_NAMES) + ")", 1)
            rest = F.substring(reference, F.length(bare) + 2, F.length(reference))
            named = named.when(bare != "", F.concat(F.try_element_at(names, bare), rest))
        named = named.otherwise(reference)
        decoded = F.when(reference.startswith("&#"), _numeric(reference))
        for name in FREQUENT:
            decoded = decoded.when(reference == f"&{name}", html5[name])
        decoded = decoded.otherwise(named)
        return F.concat(part, F.coalesce(decoded, F.lit("")))

    def decode(whole: Column) -> Column:
        found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        between = F.split(whole, pattern, -1)
        return F.when(whole.contains("&"), F.array_join(F.zip_with(between, found, one), "")).otherwise(whole)

    # An array of one, so that a text that takes work to make is made once.
    return F.element_at(F.transform(F.array(col(text)), decode), 1)


def _numeric(reference: Column) -> Column:
    digits = F.regexp_extract(reference, r"^&#(\d+);", 1)
    hexed = F.regexp_extract(reference, r"^&#[xX]([0-9A-Fa-f]+);", 1)
    code = F.when(digits != "", digits.try_cast("long")).when(hexed != "", F.conv(hexed, 16, 10).try_cast("long"))
    good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(reference)


def clean_text(html: Column | str, bare_names: bool = True) -> Column:
    """Visible text: tags become spaces, entities are decoded, blanks collapse."""
    bare = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare, bare_names), BLANKS, " "))


def page_title(html: Column | str, bare_names: bool = True) -> Column:
    return clean_text(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1), bare_names)


def excerpt(text: Column, limit: int = 400, least: int = 80) -> Column:
    """Text up to a limit, cut at the last blank when that is far enough in."""
    cut = F.substring(text, 1, limit)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = F.length(text) <= limit
    spaced = F.contains(cut, F.lit(" ")) & (at > least)
    return F.when(whole, text).when(spaced, F.substring(cut, F.lit(1), at)).otherwise(cut)


def page_excerpt(html: Column | str, limit: int = 400) -> Column:
    return excerpt(clean_text(html), limit)


def normal_text(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), BLANKS, " ")))


def text_hash(text: Column | str) -> Column:
    return F.sha2(normal_text(text), 256)


def html_text_hash(html: Column | str) -> Column:
    return text_hash(F.regexp_replace(F.coalesce(col(html), F.lit("")), r"<[^>]+>", " "))


def outlook_text(text: Column | str) -> Column:
    """Hard blanks to blanks, words split at line ends joined, blanks collapsed."""
    whole = F.coalesce(col(text), F.lit(""))
    return F.regexp_replace(F.regexp_replace(whole, r"(?U)(\w)-\s+", "$1"), BLANKS, " ")


def cut_text(text: str | None, size: int) -> Iterator[str]:
    """Pieces of at most `size` characters, cut at a blank if that is late enough.

    One walk over the text: each step looks at one window. A cut takes more than a
    quarter of a window.
    """
    whole = re.sub(r"[ \t]+", " ", text or "").strip(" ")
    at = 0
    while at < len(whole):
        end = at + size
        if end < len(whole):
            blank = whole.rfind(" ", at, end)
            if blank - at > size // 4:
                end = blank
        yield whole[at:end].strip(" ")
        at = end
        while at < len(whole) and whole[at] == " ":
            at += 1


# Characters of pieces that a task gathers before it hands a batch on.
BATCH_CHARS = 1 << 20


def text_chunks(docs: DataFrame, text: str, size: int = 24_000) -> DataFrame:
    """`docs` without their text, beside (pos, chunk) of each piece of it; a blank text has none.

    Rows come and go as Arrow batches; what a task holds is one batch of texts and
    pieces of about BATCH_CHARS characters, or one text.
    """
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, others = batch.column(0), batch.select(range(1, batch.num_columns))
            rows: list[int] = []
            pos: list[int] = []
            chunks: list[str] = []
            held = 0

            def gathered():
                return pa.RecordBatch.from_arrays(
                    [*others.take(pa.array(rows, pa.int64())).columns, pa.array(pos, pa.int32()), pa.array(chunks, pa.string())],
                    names=[*kept, "pos", "chunk"])

            for row in range(batch.num_rows):
                for at, chunk in enumerate(cut_text(texts[row].as_py(), size)):
                    rows.append(row)
                    pos.append(at)
                    chunks.append(chunk)
                    held += len(chunk)
                    if held > BATCH_CHARS:
                        yield gathered()
                        rows, pos, chunks, held = [], [], [], 0
            if rows:
                yield gathered()

    return docs.select(text, *kept).mapInArrow(cut, schema)
