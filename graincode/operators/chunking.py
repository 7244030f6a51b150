"""Chunking of symbols to embeddable texts.

symbols: file, ord, name, kind, parent, signature, docstring, code, start_line, end_line. files: file, language. imports: file, ord,
module, alias, names. Every step is expressions and ordered aggregates by file; members of one file meet in one row of the aggregate,
as the chunk that is made of them does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincode.functions.scalars import content_hash, token_estimate
from graincode.functions.shared import shuffled

#: Tokens up to which a block goes, under which symbols are merged, and over which they are split.
MAX_TOKENS, MIN_TOKENS, LARGE_TOKENS = 512, 64, 1024
CLASSES, FUNCTIONS = ("class", "struct", "interface"), ("function", "method")
OUT = ["file", "level", "symbol", "symbol_type", "start_line", "end_line", "text"]


def _header(*more: Column) -> Column:
    has = F.coalesce(F.col("parent"), F.lit("")) != ""
    return F.concat(F.col("file"), F.when(has, F.concat(F.lit(" > "), F.col("parent"))).otherwise(""), *more)


def _ordered(*fields: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct("ord", *fields)))


def file_summaries(files: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The summary chunk of every file."""
    top = F.when(F.col("parent").isNull(), F.concat(F.lit("  "), "kind", F.lit(": "), "signature"))
    own = symbols.groupBy("file").agg(F.array_compact(F.transform(_ordered(top.alias("t")), lambda x: x["t"])).alias("toc"), F.max("end_line").alias("last"))
    both = files.join(shuffled(own), "file", "left")
    heads = F.array(F.concat(F.lit("# File: "), "file"), F.concat(F.lit("# Language: "), "language"), F.lit(""))
    lines = F.concat(heads, F.coalesce("toc", F.array().cast("array<string>")))
    if imports is not None:
        names = F.coalesce(F.array_join("names", ", "), F.lit(""))
        line = F.when(names != "", F.concat(F.lit("from "), "module", F.lit(" import "), names)).otherwise(
            F.concat(F.lit("import "), "module", F.when(F.coalesce("alias", F.lit("")) != "", F.concat(F.lit(" as "), "alias")).otherwise(""))
        )
        given = imports.groupBy("file").agg(F.transform(_ordered(line.alias("t")), lambda x: x["t"]).alias("imp"))
        both = both.join(shuffled(given), "file", "left")
        block = F.when(F.col("imp").isNotNull(), F.concat("imp", F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
        lines = F.concat(heads, block, F.coalesce("toc", F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    return both.select(
        "file", F.lit("file").alias("level"), none.alias("symbol"), none.alias("symbol_type"), F.lit(1).cast("int").alias("start_line"),
        F.coalesce("last", F.lit(1)).cast("int").alias("end_line"), F.array_join(lines, "\n").alias("text"),
    )


def class_summaries(symbols: DataFrame) -> DataFrame:
    """The summary chunk of every class, struct and interface at the top of a file, with its members."""
    members = symbols.where("parent IS NOT NULL").groupBy("file", F.col("parent").alias("name"))
    members = members.agg(F.transform(_ordered(F.concat(F.lit("  "), "kind", F.lit(": "), "signature").alias("t")), lambda x: x["t"]).alias("m"))
    own = symbols.where(F.col("kind").isin(*CLASSES) & F.col("parent").isNull()).join(shuffled(members), ["file", "name"], "left")
    doc = F.when(F.coalesce("docstring", F.lit("")) != "", F.array(F.concat(F.lit('"""'), "docstring", F.lit('"""')), F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("# "), "signature"), F.lit("")), doc, F.coalesce("m", F.array().cast("array<string>")))
    return own.select("file", F.lit("class").alias("level"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_type"), "start_line", "end_line", F.array_join(lines, "\n").alias("text"))


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """One chunk a symbol."""
    text = F.concat(F.lit("# "), _header(F.lit(" > "), F.col("name")), F.lit("\n"), "code")
    return symbols.select("file", F.lit("function").alias("level"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_type"), "start_line", "end_line", text.alias("text"))


def _split_points(blanks: Column, tokens: Column) -> Column:
    """Ends of the blocks: about n / (tokens / MAX_TOKENS) lines each, pulled to a blank line near the end. blanks: whether each line is blank."""
    n = F.size(blanks)
    parts = F.greatest(F.lit(1), F.floor(tokens / MAX_TOKENS).cast("int"))
    target = F.greatest(F.lit(10), F.floor(n / parts).cast("int"))
    reach = F.least(F.lit(5), F.floor(target / 3).cast("int"))
    blank = lambda i: F.coalesce(F.try_element_at(blanks, i + 1), F.lit(False))

    def step(acc: Column, _: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        end = F.least(start + target, n)
        near = lambda off: F.when(blank(end + off), end + off + 1).when((end - off > start) & blank(end - off), end - off + 1)
        pulled = F.try_element_at(F.array_compact(F.transform(F.sequence(F.lit(0), reach - 1), near)), F.lit(1))
        to = F.when(end < n, F.coalesce(pulled, end)).otherwise(n).cast("int")
        return F.when(start < n, F.concat(acc, F.array(to))).otherwise(acc)

    steps = F.sequence(F.lit(1), F.floor(n / (target - reach + 1)).cast("int") + 1)  # no step is shorter
    return F.aggregate(steps, F.array().cast("array<int>"), step)


def split_large(symbols: DataFrame) -> DataFrame:
    """Blocks of symbols; a symbol of one line is one chunk."""
    own = symbols.withColumn("_lines", F.split("code", "\n", -1))
    many = own.where(F.size("_lines") > 1).withColumn("_blank", F.transform("_lines", lambda x: x.rlike(r"(?U)^\s*$")))
    many = many.withColumn("_ends", _split_points(F.col("_blank"), token_estimate(F.col("code"))))

    def block(to: Column, part: Column) -> Column:
        start = F.when(part == 0, 0).otherwise(F.try_element_at("_ends", part))
        return F.struct(part.alias("part"), start.alias("_from"), to.alias("to"), F.array_join(F.slice("_lines", start + 1, to - start), "\n").alias("body"))

    kept = ["file", "parent", "name", "kind", "start_line"]
    at = many.select(*kept, F.element_at("_lines", 1).alias("_line"), F.inline(F.transform("_ends", block)))  # only a block's own text goes on
    head = _header(F.lit(" > "), F.col("name"))
    first = F.concat(F.lit("# "), head, F.lit("\n"), "body")
    later = F.concat(F.lit("# "), head, F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")\n"), "_line", F.lit("\n# ...\n"), "body")
    blocks = at.select(
        "file", F.lit("block").alias("level"), F.concat("name", F.lit("["), F.col("part").cast("string"), F.lit("]")).alias("symbol"), F.col("kind").alias("symbol_type"),
        (F.col("start_line") + F.col("_from")).cast("int").alias("start_line"), (F.col("start_line") + F.col("to") - 1).cast("int").alias("end_line"),
        F.when(F.col("part") == 0, first).otherwise(later).alias("text"),
    )
    return blocks.unionByName(symbol_chunks(own.where(F.size("_lines") <= 1)))


def merge_small(symbols: DataFrame) -> DataFrame:
    """One chunk of all given symbols of a (file, parent)."""
    part = F.concat(F.lit("\n# "), "kind", F.lit(": "), "name", F.lit("\n"), "code")
    own = symbols.groupBy("file", "parent").agg(F.transform(_ordered(part.alias("t")), lambda x: x["t"]).alias("p"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# "), _header(F.lit(" > (grouped small symbols)")))), "p"), "\n")
    return own.select("file", F.lit("function").alias("level"), F.lit(None).cast("string").alias("symbol"), F.lit("grouped").alias("symbol_type"), "start_line", "end_line", text.alias("text"))


def chunk(files: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, split_raw: bool = False) -> DataFrame:
    """All chunks, with content_hash: summaries; members and functions split, merged or kept by size; others merged or kept.

    split_raw splits large symbols of other kinds (whole raw files) too.
    """
    tokens = token_estimate(F.col("code"))
    work = symbols.where(~(F.col("kind").isin(*CLASSES) & F.col("parent").isNull())).withColumn("_t", tokens)
    may_split = F.col("parent").isNotNull() | F.col("kind").isin(*FUNCTIONS) | F.lit(split_raw)
    large, small = work.where(may_split & (F.col("_t") > LARGE_TOKENS)), work.where(F.col("_t") < MIN_TOKENS)
    rest = work.where((F.col("_t") >= MIN_TOKENS) & ~(may_split & (F.col("_t") > LARGE_TOKENS)))
    out = file_summaries(files, symbols, imports)
    for more in (class_summaries(symbols), symbol_chunks(rest), split_large(large), merge_small(small)):
        out = out.unionByName(more.select(*OUT))
    return out.withColumn("content_hash", content_hash(F.col("text")))
