"""Registered query of word-processor packages: documents are packed into packages, read back, and compared with their lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import word
from .catalog import query, table

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_STYLES = f'<w:styles xmlns:w="{_NAMESPACE}"><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Head"><w:name w:val="Head"/><w:basedOn w:val="Base"/></w:style></w:styles>'
_NUMBERING = f'<w:numbering xmlns:w="{_NAMESPACE}"><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'


def package_of(text: str) -> bytes:
    """A package with a paragraph for each line: the first of style Head, every fifth from the second a list item, every seventh after a page break, every third run direct bold."""
    body = []
    for i, line in enumerate(text.split("\n")):
        props = '<w:pStyle w:val="Head"/>' if i == 0 else ""
        props += '<w:pageBreakBefore/>' if i and i % 7 == 0 else ""
        props += f'<w:numPr><w:ilvl w:val="{i // 5 % 2}"/><w:numId w:val="1"/></w:numPr>' if i % 5 == 1 else ""
        run = "<w:rPr><w:b/></w:rPr>" if i % 3 == 2 else ""
        body.append(f'<w:p><w:pPr>{props}</w:pPr><w:r>{run}<w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{"".join(body)}</w:body></w:document>'.encode())
        z.writestr("word/styles.xml", _STYLES)
        z.writestr("word/numbering.xml", _NUMBERING)
    return out.getvalue()


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [b"no package" if d % 11 == 4 else package_of(t) for d, t in zip(b["doc_id"], b["text"], strict=True)]})

    docs = table(spark, sf_dir, "documents").select("doc_id", X.without_control(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.mapInPandas(pack, "doc_id long, content binary")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE doc_id % 11 <> 4), v AS (SELECT *, length(regexp_replace(line, '[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]', '', 'g')) AS size FROM l),
a AS (SELECT doc_id, count(*) FILTER (WHERE n % 5 <> 1 AND size > 0) AS paragraphs, count(*) FILTER (WHERE n % 5 = 1) AS list_items, count(*) FILTER (WHERE n > 0 AND n % 7 = 0) AS page_breaks, CAST(sum(size) AS BIGINT) AS letters, CAST(coalesce(sum(CASE WHEN n = 0 OR n % 3 = 2 THEN size END), 0) AS BIGINT) AS bold_letters FROM v GROUP BY 1)
SELECT doc_id, doc_id % 11 = 4 AS failed, coalesce(paragraphs, 0) AS paragraphs, coalesce(list_items, 0) AS list_items, coalesce(page_breaks, 0) AS page_breaks, coalesce(letters, 0) AS letters, coalesce(bold_letters, 0) AS bold_letters FROM documents LEFT JOIN a USING (doc_id)""")
def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-3, TRE-4: packages to blocks and runs; no letter is lost, styles reach the runs, and a file that is no package disturbs none."""
    packages = _packages(spark, sf_dir)
    rows = word.rows(packages)
    size = F.length(F.regexp_replace("text", f"[{X.WS}]", "")).cast("long")
    found = word.summary(table(spark, sf_dir, "documents"), rows, word.blocks(rows))  # the same keys, without packing again
    letters = word.runs(rows).groupBy("doc_id").agg(F.sum(size).alias("letters"), F.sum(F.when(F.col("bold"), size)).alias("bold_letters"))
    out = found.join(letters, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("error").isNotNull().alias("failed"), "paragraphs", "list_items", "page_breaks", F.coalesce("letters", zero).alias("letters"), F.coalesce("bold_letters", zero).alias("bold_letters"))
