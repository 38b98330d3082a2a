"""Line-first quality rules.

Each line is judged by itself; failing lines are removed; a document that loses
too much of its text, or that fails the whole-text rules, is rejected.

Defined results: a null or empty text has no words and is rejected by the
minimum of words; null ids pass through; repeated rows are judged one by one;
an empty table gives an empty table. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, table

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: The share of characters that lines may take with them.
MAX_LOST = 0.3

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SEPARATOR = re.compile(r"[|»›·•>]")
BOILERPLATE = re.compile(
    r"\b(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved"
    r"|enable javascript|javascript is disabled|sign in|log in|sign up|subscribe to|click here|read more|share (?:this|on)"
    r"|back to top|skip to content|lorem ipsum"
    r"|accepter (?:tous )?les cookies|politique de confidentialité|mentions légales|tous droits réservés|se connecter|cliquez ici|lire la suite|haut de page"
    r"|cookies akzeptieren|datenschutzerklärung|alle rechte vorbehalten|hier klicken|weiterlesen|zum seitenanfang"
    r"|aceptar (?:todas )?las cookies|política de privacidad|todos los derechos reservados|iniciar sesión|haga clic aquí|leer más|volver arriba)\b",
    re.I,
)
LETTER = re.compile(r"[^\W\d_]")

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_removed_lines long, lost_share double, cleaned string"
)


def count_repeated(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def line_fails(line: str) -> str | None:
    """The rule that the line breaks, if any. A blank line breaks none."""
    words = line.split()
    if not words:
        return None
    chars = sum(map(len, words))
    if len(words) >= 4 and 4 * len(SEPARATOR.findall(line)) >= len(words):
        return "navigation"
    marks = sum(line.count(c) for c in SYMBOLS) + line.count("!!")
    if marks >= 3 and 10 * marks > chars:
        return "punctuation"
    if chars >= 3 and not LETTER.search(line):
        return "punctuation"
    if len(words) <= 12 and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines, seen, dup, kept, removed, lost, total = text.split("\n"), set(), 0, [], 0, 0, 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
        total += len(line)
        if line_fails(line):
            removed += 1
            lost += len(line)
        else:
            kept.append(line)
    repeated = count_repeated(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    share = lost / total if total else 0.0
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated, failed, not failed and share <= max_lost,
        len(lines), removed, share, "\n".join(kept),
    )


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The id, the measures, the verdict and the cleaned text of every row: one narrow stage, no shuffle."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):  # small batches: bounded memory
                part = batch.slice(at, 512)
                rows = [judge(t.as_py(), max_lost) for t in part.column("text")]
                columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    return docs.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines. All columns of docs stay; n_chars, if any, is that of the new text."""
    bounded(spark)
    schema, at = docs.schema, docs.columns.index("text")
    kept_at, clean_at = 6, 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [judge(t.as_py()) for t in part.column(at)]
                texts = pa.array([r[clean_at] for r in rows], pa.string())
                part = part.set_column(at, batch.schema.field(at).with_type(pa.string()).with_nullable(True), texts)
                yield part.filter(pa.array([r[kept_at] for r in rows], pa.bool_()))

    out = docs.mapInArrow(run, schema)
    return recount(out)


def recount(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


__all__ = ["op9", "quality_rules", "stage"]
