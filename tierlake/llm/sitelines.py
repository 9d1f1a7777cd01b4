"""Problem 4: lines that one source repeats in many of its documents, by distributed PrefixSpan over line identifiers.

A line's identifier is the 64-bit hash of the line without spaces and tabs at its ends. First the frequent lines of each
source are counted, one count a document, added up in the map tasks before the shuffle, so a source with a third of all
rows is no group of its own anywhere. Then each document is reduced to the sequence of its frequent lines, and frequent
prefixes are extended by the frequent lines that follow them, level by level. A prefix is given up where a line stands
within its last gap in every document that has it: no closed sequence begins with it. So a notice of n lines takes n
prefixes, not one for each of its 2^n parts, and closed sequences tell all frequent ones. What they hold is deleted.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.plans.shared import cut, sized

#: A line or sequence is repeated if it stands in so many documents of its source, and in this share of them.
LEAST, SHARE = 5, 0.3
#: A text of which less than this share is left without its source's lines is judged whole.
LITTLE = 0.25

#: Lines of all sources together up to which they are broadcast (two numbers each), and tasks that a source is dealt to above.
FEW, SALTS = 100_000, 16

_TRIM = "trim(BOTH ' \\t' FROM x)"
_LINES = "split(text, '\\n', -1)"


def frequent(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(frequent lines: source, line, support; needs: source, needed), needed being the documents a sequence must stand in.

    Null texts count as documents of their source; documents without a source have no site and no frequent lines.
    """
    docs = docs.where(F.col("source").isNotNull())
    needs = docs.groupBy("source").agg(F.count("*").alias("n")).select("source", F.greatest(F.lit(least), F.ceil(F.col("n") * share)).alias("needed"))
    each = docs.select("source", F.explode(F.expr(f"array_distinct(transform({_LINES}, x -> {_TRIM}))")).alias("x")).where("x <> ''")
    counts = each.groupBy("source", F.expr("xxhash64(x)").alias("line")).agg(F.count("*").alias("support"))
    return counts.where(F.col("support") >= least).join(needs, "source").where("support >= needed").drop("needed"), needs


def with_site(docs: DataFrame, lines: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with _site, the frequent lines of its source (``lines``: source, line); none where it has none.

    Up to FEW lines all in all (narrow rows, counted) they are broadcast; above, both sides are joined by source and a salt
    of SALTS, so that a source with a third of all documents is in as many tasks.
    """
    lines = cut(lines.select("source", "line").distinct())
    site = lines.groupBy(F.col("source").alias("_of")).agg(F.collect_set("line").alias("_site"))
    if lines.count() <= FEW:
        return docs.join(F.broadcast(site), F.col("source") == F.col("_of"), how).drop("_of")
    salted = site.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = docs.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return each.join(salted, (F.col("source") == F.col("_of")) & (F.col("_part") == F.col("_salt")), how).drop("_of", "_part", "_salt")


def sequences(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, source, seq array<struct<line_no, line>>): the frequent lines of each document that has any, in order."""
    of = with_site(docs.select("doc_id", "source", "text").where("text is not null"), lines)
    numbered = f"transform({_LINES}, (x, i) -> struct(cast(i + 1 as bigint) as line_no, if({_TRIM} = '', null, xxhash64({_TRIM})) as line))"
    return of.select("doc_id", "source", F.expr(f"filter({numbered}, y -> y.line is not null and array_contains(_site, y.line))").alias("seq")).where("size(seq) > 0")


def prefixspan(seqs: DataFrame, needs: DataFrame, longest: int | None = None) -> DataFrame:
    """(source, pattern array<bigint>, support): sequences of frequent lines, gaps allowed, that stand in enough documents.

    Those that no line after them makes longer at the same support; every other frequent sequence is part of one of these with its
    support. Each level holds, for each document and frequent pattern, the earliest place where the pattern is complete and
    the lines between that and the place before; the lines after it extend the pattern, until none is frequent. With
    ``longest`` all frequent sequences of up to so many lines, given up for nothing. Documents of a source with equal sequences are one row with their number.
    """
    at = seqs.groupBy("source", F.expr("transform(seq, y -> y.line)").alias("ids")).agg(F.count("*").alias("docs")).withColumn("done", F.lit(0)).withColumn("pattern", F.expr("cast(array() as array<bigint>)"))
    levels: list[DataFrame] = []
    closed = longest is None
    for level in count(1):
        if longest is not None and level > longest:
            break
        rest = "slice(ids, done + 1, size(ids))"
        grown = at.select("source", "ids", "docs", "done", "pattern", F.explode(F.expr(f"array_distinct({rest})")).alias("line")).withColumn("step", F.expr(f"cast(array_position({rest}, line) as int)"))
        grown = grown.select("source", "ids", "docs", F.expr("array_distinct(slice(ids, done + 1, step - 1))").alias("gap"), F.expr("done + step").alias("done"), F.expr("concat(pattern, array(line))").alias("pattern"))
        # documents of each pattern, and of each line in its last gap; a line in that gap of all leads to a sequence that has all that this one leads to
        beside = grown.select("source", "pattern", "docs", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "gap") if closed else F.array(F.lit(None).cast("bigint"))).alias("line")).groupBy("source", "pattern", "line").agg(F.sum("docs").alias("n"))
        told = beside.groupBy("source", "pattern").agg(F.max(F.when(F.col("line").isNull(), F.col("n"))).alias("support"), F.max(F.when(F.col("line").isNotNull(), F.col("n"))).alias("around"))
        live, n = sized(told.join(needs, "source").where("support >= needed and (around is null or around < support)").select("source", "pattern", "support"))
        if not n:
            break
        levels.append(live)
        at = cut(grown.drop("gap").join(live.select("source", "pattern"), ["source", "pattern"], "left_semi"))
    if not levels:
        return needs.sparkSession.createDataFrame([], "source string, pattern array<bigint>, support bigint")
    if not closed:
        return reduce(DataFrame.union, levels)
    longer = [x.select("source", F.expr("slice(pattern, 1, size(pattern) - 1)").alias("pattern"), "support").distinct() for x in levels[1:]]
    return reduce(DataFrame.union, [x.join(y, ["source", "pattern", "support"], "left_anti") if y is not None else x for x, y in zip(levels, [*longer, None])]).select("source", "pattern", "support")


def mined(docs: DataFrame, share: float = SHARE, least: int = LEAST, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frequent sequences, sequences of documents); see ``prefixspan`` and ``sequences``."""
    lines, needs = frequent(docs, share, least)
    needs = sized(needs)[0]
    seqs = cut(sequences(docs, lines))
    return cut(prefixspan(seqs, needs, longest)), seqs


def parts(patterns: DataFrame) -> DataFrame:
    """(source, line): the lines of frequent sequences, each of which is frequent itself."""
    return patterns.select("source", F.explode("pattern").alias("line")).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no): the occurrences of frequent sequences, single lines included; lines count from 1, empty ones too.

    Null and empty texts, empty lines and documents without a source have no rows. A repeated row of a document counts as
    a document of its own in the support, as the table states it.
    """
    patterns, seqs = mined(docs)
    gone = with_site(seqs, parts(patterns))
    return gone.select("doc_id", F.explode(F.expr("filter(seq, y -> array_contains(_site, y.line))")).alias("y")).select("doc_id", "y.line_no")


def without_site_lines(docs: DataFrame, text: str = "text", blank: bool = False, longest: int | None = None) -> DataFrame:
    """``docs`` with the lines of its source's frequent sequences taken out of each text; null texts and other columns stay.

    ``blank`` leaves an empty line for each, so that the others keep their numbers. ``longest`` ends the mining early, which
    changes nothing here: the first level holds a sequence for every line of longer ones.
    """
    patterns, _ = mined(docs.select("doc_id", "source", "text"), longest=longest)
    kept = f"transform({_LINES}, x -> if(array_contains(_site, xxhash64({_TRIM})), '', x))" if blank else f"filter({_LINES}, x -> not array_contains(_site, xxhash64({_TRIM})))"
    return with_site(docs, parts(patterns), "left").withColumn(text, F.expr(f"if(_site is null or text is null, text, array_join({kept}, '\n'))")).drop("_site")


def own_text(docs: DataFrame) -> DataFrame:
    """``docs`` and own: what to judge of each text, that is the text with its site lines blanked, or the whole text where less than LITTLE of its characters would be left.

    Copies of one text that make up SHARE of their source have no lines but site lines. Lines keep their numbers.
    """
    chars = lambda c: F.length(F.translate(c, " \t\r\n", ""))
    return without_site_lines(docs, "own", blank=True, longest=1).withColumn("own", F.when(chars("own") < LITTLE * chars("text"), F.col("text")).otherwise(F.col("own")))
