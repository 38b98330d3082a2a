"""Personal data by patterns and by what the corpus gives away.

1. Patterns find the base spans: email, ip, card, phone.
2. Each base match is a protected entity; every word of a text that holds it, outside
   base spans, is scored. p(entity | word) is the share of the texts with the word
   that hold the entity, smoothed by SMOOTHING texts that hold it as often as any
   text does. Its disclosure is PMI(entity; word) / IC(entity): near 1 when the word
   gives the entity away, lower where a few texts are all there is to go by.
3. A word that discloses an entity to DISCLOSURE or more is a span of kind ``term``
   wherever it stands in a text with that entity. sanitise() takes out base matches
   and such words, or puts a general form in place of those that other texts use as
   well.

All counts are of distinct texts, so copies of a document change nothing. Those of
the corpus are taken of the words that their counts beside entities do not rule out
alone; a bitmap of BITS bits tells the scan which those are.

Defined results: a null or empty text has no spans (and the digest of nothing);
a null id passes through; repeated rows are done one by one; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_of, key_of, materialise, table

DISCLOSURE = 0.8
SMOOTHING = 1.0
BITS = 1 << 24
KINDS = ("email", "ip", "card", "phone")

# Each finds what its plain form finds from left to right, without trying a run of characters again from its middle.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if m[1] and all(int(x) <= 255 if len(x) < 9 else not x.strip("0") or int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m[1].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def words_beside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words outside the spans, which are in order of their starts."""
    at, taken = 0, 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][1] < m.end():
            taken = max(taken, spans[at][2])
            at += 1
        if m.start() >= taken:
            yield m[0].lower(), m.start(), m.end()


def entity_of(kind: str, said: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{re.sub(r'[^0-9a-z@.]', '', said.lower())}") - 2**63


def text_id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


BASE_SCHEMA = "row long, key long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, text_id long, text string"


def find_base(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: base spans, and its text if it has any. Not yet stable in row: materialise it before a second use."""
    names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[list] = [[] for _ in names]
                for text in part.column(1):
                    text = text.as_py() or ""
                    spans = base_spans(text)
                    said = _said(spans)
                    count = [sum(s[0] == k for s in spans) for k in KINDS]
                    for column, value in zip(out, (row, None, *count, said, hashlib.sha256(said.encode()).hexdigest(), text_id(text), text if spans else None), strict=True):
                        column.append(value)
                    row += 1
                longs = [pa.array(c, pa.int64()) for c in (out[0], *out[2:6], out[8])]
                columns = [longs[0], part.column(0), *longs[1:5], pa.array(out[6], pa.string()), pa.array(out[7], pa.string()), longs[5], pa.array(out[9], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key_of(id_column).alias("key"), text_column).mapInArrow(run, BASE_SCHEMA)


def words_with(texts: DataFrame, name: str) -> DataFrame:
    """name, entity, word of all entities and words of the texts, given with their base spans; each once in a row. Word is null once for each entity, entity once for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, base, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = all_spans(base, None)
                words = pa.array([None, *{w for w, _, _ in words_beside(text, spans)}], pa.string())
                for e in [None, *{entity_of(k, text[a:b]) for k, a, b in spans}]:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.int64()), pa.array([e] * len(words), pa.int64()), words], [name, "entity", "word"])

    return texts.select(name, "base", "text").mapInArrow(run, f"{name} long, entity long, word string")


def corpus_counts(docs: DataFrame, words: DataFrame, text_column: str) -> DataFrame:
    """word, n_word: the number of distinct texts that hold the word, of the given words."""
    at = F.crc32(F.col("word").cast("binary")) % BITS
    parts = words.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    bits = {r.k: bytes(r.bits) for r in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held, ids = [], []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    number = text_id(text or "")
                    for w in {x.lower() for x in set(WORD.findall(text or ""))}:
                        h = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BITS
                        part = bits.get(h >> 15)
                        if part and part[(h & 32767) >> 3] >> (h & 7) & 1:
                            held.append(w)
                            ids.append(number)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(ids, pa.int64())], ["word", "text_id"])

    held = docs.select(text_column).mapInArrow(run, "word string, text_id long").distinct()
    return held.groupBy("word").agg(F.count("*").alias("n_word")).join(words, "word")


def disclosing_terms(docs: DataFrame, base: DataFrame, text_column: str = "text", disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """entity, word, general: the words that give an entity away; general if enough texts use the word without it."""
    texts = base.where("text is not null").groupBy("text_id").agg(F.first("base").alias("base"), F.first("text").alias("text"))
    with_entity = materialise(words_with(texts, "text_id").groupBy("entity", "word").agg(F.count("*").alias("n_both")), "pii-with")
    entities = with_entity.where("entity is not null and word is null").select("entity", F.col("n_both").alias("n_entity"))
    # Texts that hold a word and any entity are texts that hold it: words that this alone rules out are not counted in the corpus.
    beside = with_entity.where("entity is null and word is not null").select("word", F.col("n_both").alias("n_beside"))
    total = F.lit(float(max(1, base.select("text_id").distinct().count())))
    share = F.col("n_entity") / total
    told = lambda n: F.when(share < 1, F.log2((F.col("n_both") + smoothing * share) / (n + smoothing) / share) / -F.log2(share)).otherwise(F.lit(0.0))
    together = with_entity.where("word is not null").join(entities, "entity").join(beside, "word")
    together = materialise(together.where(told(F.col("n_beside")) >= disclosure), "pii-together")
    words = together.select("word").distinct()
    counts = corpus_counts(docs, words, text_column)
    n_word = F.greatest(F.coalesce("n_word", F.lit(0)), "n_both").cast("double")
    scored = together.join(counts, "word", "left").withColumn("n_word", n_word).withColumn("disclosure", told(F.col("n_word")))
    return scored.where(F.col("disclosure") >= disclosure).select("entity", "word", "disclosure", (F.col("n_word") > 2 * F.col("n_both")).alias("general"))


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """A row for each document: key, text_id, the counts and digest of the base spans, and terms: an array of (start, end, general)."""
    base = materialise(find_base(docs, id_column, text_column), "pii-base")
    terms = materialise(disclosing_terms(docs, base, text_column, **options), "pii-terms")
    texts = base.where("text is not null").select("row", "base", "text")
    # general only if the word is so for every entity of the text that it discloses
    told = words_with(texts, "row").where("entity is not null and word is not null").join(terms.select("entity", "word", "general"), ["entity", "word"]).groupBy("row", "word").agg(F.min("general").alias("general"))
    told = told.groupBy("row").agg(F.collect_list(F.struct("word", "general")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("general", pa.bool_())]))
        for batch in batches:
            out = []
            for base, text, told in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                general = {t["word"]: t["general"] for t in told}
                out.append([{"start": a, "end": b, "general": general[w]} for w, a, b in words_beside(text, all_spans(base, None)) if w in general])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row", "terms"])

    added = texts.join(told, "row").select("row", "base", "text", "told").mapInArrow(run, "row long, terms array<struct<start:int,end:int,general:boolean>>")
    return base.drop("text").join(added, "row", "left")


def all_spans(base: str | None, terms) -> list[tuple[str, int, int]]:
    """Base spans and terms by start; at one place base kinds come first, in their order."""
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in (base or "").split(",") if x)]
    spans += sorted({("term", t["start"], t["end"]) for t in terms or ()})
    return sorted(spans, key=lambda s: (s[1], (*KINDS, "term").index(s[0])))


def redact(text: str, base: str | None, terms) -> str:
    """The text with base matches as [KIND], disclosing words as [TERM], or as [WORD] where they are general."""
    general = {t["start"]: t["general"] for t in terms or ()}
    out, at = [], 0
    for kind, start, end in all_spans(base, terms):
        if start >= at:
            out += [text[at:start], f"[{'WORD' if general.get(start) else 'TERM'}]" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [b.as_py() if t.as_py() is None else _said(all_spans(b.as_py(), t.as_py())) for b, t in zip(batch.column(6), batch.column(7), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string())], ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = found.select("key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "terms")
    out = rows.mapInArrow(run, "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.select(id_of("key").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """id and text of every row, with what find_spans() finds taken out. Rows that share an id, or have none, keep their own texts."""
    found = find_spans(docs, id_column, text_column, **options).select("key", "text_id", "base", "terms").dropDuplicates(["key", "text_id"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [text_id(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], ["key", "text", "text_id"])

    rows = docs.select(key_of(id_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(named, "key long, text string, text_id long")
    rows = rows.join(found.hint("shuffle_hash"), ["key", "text_id"]).select("key", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(*(x.as_py() for x in row)) for row in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, "key long, text string").select(id_of("key").alias(id_column), "text")
