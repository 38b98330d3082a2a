"""The corpus model: binary > function > opcode, as relations.

functions(binary, category, func, ops): one row for each function, its opcodes as
an array. Everything else derives from it by narrow steps; only order *across*
functions of a binary needs a window, which moves counts or a few opcodes of each
function. N-grams take what runs on from one function to the next from such rows
alone; where each function itself needs them (offsets, contexts), they are joined
back by a hash of the whole row, and that join moves the sequences once.

Defined results: a function without an id comes before all others of its binary; functions
that share an id are ordered by a hash of their rows; equal rows are functions of
their own; a null binary is a binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer parts than there are cores: a small input in one file. A larger one is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def tokens_of(text: Column) -> Column:
    """The runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def document_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: a binary is a source and language, a function a document, an opcode a word."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        F.concat_ws("/", "source", "lang").alias("binary"), F.col("lang").alias("category"), F.col("doc_id").alias("func"), tokens_of(F.col("text")).alias("ops")
    ).where(F.lower("text").rlike("[a-z0-9]"))  # not by ops: Spark would make them once more for the filter


def event_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a corpus: a binary is a user, a function a day, an opcode an event type. A user's day is bounded."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    rows = events.groupBy("user_id", day.alias("func")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return rows.select(F.col("user_id").cast("string").alias("binary"), F.lit(None).cast("string").alias("category"), "func", F.col("e.event_type").alias("ops"))


def normalise(mnemonic: Column) -> Column:
    """Cut at @, cut at the dot, lower-case."""
    return F.lower(F.substring_index(F.substring_index(mnemonic, "@", 1), ".", 1))


def token_rows(functions: DataFrame) -> DataFrame:
    """binary, category, func, i, opcode."""
    return functions.select("binary", "category", "func", F.posexplode("ops").alias("i", "opcode"))


#: Two hashes of a whole row: rows with equal ones are copies. Functions may lack an id or share it.
ROW = ["__row1", "__row2"]


def _keyed(functions: DataFrame) -> DataFrame:
    whole = ["binary", "func", "ops"]
    return functions.withColumns({ROW[0]: F.xxhash64(*whole), ROW[1]: F.xxhash64(F.lit(1), *reversed(whole))})


def _order(*by: str):
    """Functions of a binary by id, those without one first; rows that share an id by their hash."""
    return Window.partitionBy(*by).orderBy("func", *ROW)


def _told(functions: DataFrame, small: DataFrame) -> DataFrame:
    """functions with what small tells: small has a row for each function, also for copies, so functions gives each of them once."""
    return functions.dropDuplicates(ROW).join(small, ROW).drop(*ROW)


def with_offset(functions: DataFrame) -> DataFrame:
    """Adds offset: the opcodes of the binary before each function. Every row stays, whatever its id."""
    keyed = _keyed(functions)
    before = _order("binary").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.select(*ROW, F.coalesce(F.sum(F.size("ops")).over(before), F.lit(0)).cast("long").alias("offset"))
    return _told(keyed, sizes)


def positions(functions: DataFrame) -> DataFrame:
    """binary, category, func, pos (0-based in the binary), opcode."""
    return with_offset(functions).select("binary", "category", "func", "offset", F.posexplode("ops").alias("i", "opcode")).select("binary", "category", "func", (F.col("offset") + F.col("i")).alias("pos"), "opcode")


#: Functions that one window sorts, where ids are dense: windows over a whole binary see a row for each so many functions.
SPAN = 4096


def _after(heads: DataFrame, k: int) -> DataFrame:
    """Adds following to (binary, func, row hashes, head, ...): the first k opcodes of what comes after. Within spans of ids first, then from span to span."""
    joined = lambda c, w: F.slice(F.flatten(F.collect_list(c).over(w.rowsBetween(1, k))), 1, k)
    span = F.coalesce(F.floor(F.col("func") / SPAN), F.lit(-(2**62))).alias("span")
    within = _order("binary", "span")
    near = heads.select("*", span).withColumns({"near": joined("head", within), "place": F.row_number().over(within)})
    starts = near.where("place = 1").select(F.col("binary").alias("b"), F.col("span").alias("s"), F.slice(F.concat("head", "near"), 1, k).alias("start"))
    later = starts.withColumn("later", joined("start", Window.partitionBy("b").orderBy("s"))).drop("start")
    both = near.join(later, F.col("binary").eqNullSafe(F.col("b")) & (F.col("span") == F.col("s")))
    return both.withColumn("following", F.slice(F.concat("near", "later"), 1, k)).drop("span", "near", "place", "b", "s", "later")


def with_following(functions: DataFrame, k: int) -> DataFrame:
    """Adds following: the next k opcodes of the binary after each function."""
    if k < 1:
        return functions.withColumn("following", F.array().cast("array<string>"))
    keyed = _keyed(functions)
    heads = _after(keyed.select("binary", "func", *ROW, F.slice("ops", 1, k).alias("head")), k)
    return _told(keyed, heads.select(*ROW, "following"))


def last_of(ops: str, k: int) -> Column:
    return F.slice(ops, -F.least(F.size(ops), F.lit(k)), k)


def ends_with_following(functions: DataFrame, k: int) -> DataFrame:
    """binary, tail, following: the last k opcodes of each function, and the k after it. No sequence is moved."""
    rows = _keyed(functions.where(F.size("ops") > 0)).select("binary", "func", *ROW, F.slice("ops", 1, k).alias("head"), last_of("ops", k).alias("tail"))
    return _after(rows, k).select("binary", "tail", "following")


def with_preceding(functions: DataFrame, k: int) -> DataFrame:
    """Adds preceding: the k opcodes of the binary before each function, fewer at its start."""
    keyed = _keyed(functions)
    tails = keyed.where(F.size("ops") > 0).select("binary", "func", *ROW, last_of("ops", k).alias("tail"))
    tails = tails.select(*ROW, F.flatten(F.collect_list("tail").over(_order("binary").rowsBetween(-k, -1))).alias("p"))
    tails = tails.select(*ROW, F.when(F.size("p") > k, F.slice("p", F.size("p") - (k - 1), k)).otherwise(F.col("p")).alias("preceding"))
    return _told(keyed.where(F.size("ops") > 0), tails)


def prefixes(functions: DataFrame, cap: int) -> DataFrame:
    """binary, category, ops: the first cap opcodes of each binary in order. Bounded by cap."""
    rows = with_offset(functions).where(F.col("offset") < cap)
    rows = rows.select("binary", "category", "func", F.expr(f"slice(ops, 1, cast({cap} - offset as int))").alias("ops"))
    listed = rows.groupBy("binary").agg(F.max("category").alias("category"), F.array_sort(F.collect_list(F.struct("func", "ops"))).alias("parts"))
    return listed.select("binary", "category", F.flatten("parts.ops").alias("ops"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """opcode, id: dense from 0 in order of the opcode. Ranks within ranges of a sorted partitioning, so no task sees all words."""
    words = tokens.select("opcode").distinct().repartitionByRange("opcode").sortWithinPartitions("opcode")
    marked = words.select("opcode", F.spark_partition_id().alias("part"))
    marked = marked.select("opcode", "part", F.row_number().over(Window.partitionBy("part").orderBy("opcode")).alias("r"))
    base = marked.groupBy("part").agg(F.min("opcode").alias("first"), F.count("*").alias("n"))
    base = base.select("part", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return marked.join(base, "part").select("opcode", (F.col("base") + F.col("r") - 1).cast("long").alias("id"))
