"""Anchors of HTML pages by a tolerant tokenizer over Arrow batches.

One regular expression walks a page and always consumes what it meets, so the
time is linear in the page however broken it is: comments, the contents of
elements that hold no markup, and the tags that matter here.  A comment, element
or tag that is never closed reaches to the end of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lithic.functions import text as T

# a tag's attributes: quotes only count after an equals sign
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|textarea|title|xmp|noembed|noframes|template)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</(?P=raw)(?=[\s/>])|\Z)|\Z)"""
    rf"""|<(?P<tag>a|base)(?P<rest>(?=[\s/>]){_ATTRIBUTES})(?:>|\Z)|(?P<close></a(?=[\s/>])[^>]*+>?)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""", re.S)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[^>]*+>?", re.S)


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by name in lower case, references resolved; of a repeated one the last counts, one without a value is empty."""
    return {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(rest)}


def links(page: str) -> tuple[str | None, list[tuple[str, str]]]:
    """(first <base href>, [(href, text)]) of a page's live anchors in document order; a text ends with its anchor or where the next one begins."""
    base, found, opened = None, [], None

    def ended(at: int) -> None:
        if opened is not None:
            found.append((opened[0], " ".join(html.unescape(_MARKUP.sub(" ", page[opened[1] : at])).split())))

    for m in _TOKEN.finditer(page):
        if m["close"]:
            ended(m.start())
            opened = None
        elif m["tag"]:
            values = attributes(m["rest"])
            if m["tag"].lower() == "base":
                base = values.get("href") if base is None else base
                continue
            ended(m.start())
            opened = (values["href"].strip(), m.end()) if "href" in values else None
    ended(len(page))
    return base, found


def anchors(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, pos, href, text, link) of every live <a href> in document order.

    Anchors in comments, scripts and the like are none.  href is the attribute
    with its character references resolved, link is absolute: against the page's
    first <base href>, else its URL.  A null page has no anchors; repeated rows
    are rows.
    """
    kept = [StructField("_id", pages.schema[id_col].dataType), StructField("_url", pages.schema[url_col].dataType)]
    shape = StructType([*kept, *StructType.fromDDL("pos int, href string, text string, base string").fields])
    out = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, href, text, base = [], [], [], [], []
            for i, page in enumerate(batch.column(2)):
                first, found = links(page.as_py() or "")
                row += [i] * len(found)
                pos += range(len(found))
                href += [h for h, _ in found]
                text += [t for _, t in found]
                base += [first] * len(found)
            at = pa.array(row, pa.int64())
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(href, pa.string()), pa.array(text, pa.string()), pa.array(base, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    found = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), html_col).mapInArrow(run, shape)
    base = F.when(F.col("base").isNull(), F.col("_url")).otherwise(T.absolute_url(F.col("_url"), F.col("base")))
    found = found.withColumn("_base", base)
    return found.select(F.col("_id").alias(id_col), "pos", "href", "text", T.absolute_url(F.col("_base"), F.col("href")).alias("link"))
