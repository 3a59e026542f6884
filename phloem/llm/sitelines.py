"""Lines repeated across one source's documents: suffix arrays over line identifiers by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.storage import Stage


def normal_line(line: Column) -> Column:
    """Trimmed, each run of white space one blank, lower case, each run of digits one sign."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"(?U)\s+", " "))), "[0-9]+", "0")


def line_table(docs: DataFrame, id_col: str, source: str, body: str) -> DataFrame:
    """(doc, article, id, seq, line_no, line): the lines that may count, with a 64-bit name of (source, line).

    seq numbers a document's non-blank lines, so blank lines do not break a block; headings and lines without a letter
    do. doc names one version of a document, article its id. Rows without a source, an id or a body have no lines.
    """
    numbered = F.filter(F.transform(F.split(F.col(body), "\n"), lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text"))), lambda s: F.length(F.trim(s["text"])) > 0)
    rows = docs.filter(F.col(source).isNotNull() & F.col(id_col).isNotNull() & F.col(body).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(id_col).alias("article"), F.xxhash64(id_col, body, source).alias("doc"), F.col(source).alias("source"), F.posexplode(numbered).alias("seq", "l")
    )
    lines = rows.select("id", "article", "doc", "source", "seq", F.col("l.line_no").alias("line_no"), F.col("l.text").alias("text"))
    counted = lines.filter(~F.col("text").rlike(r"(?U)^\s*#") & F.col("text").rlike(r"\p{L}"))  # on the line as it is, so that it is normalised once
    return counted.select("doc", "article", "id", "seq", "line_no", F.xxhash64("source", normal_line(F.col("text"))).alias("line"))


def _shared(places: DataFrame, name: str, min_docs: int) -> DataFrame:
    """The names that stand in at least ``min_docs`` distinct articles. Every row is one (article, name) after a partial distinct."""
    return places.select(name, "article").distinct().groupBy(name).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def suffix_levels(stage: Stage, places: DataFrame, min_docs: int) -> list[DataFrame]:
    """Prefix doubling: level k has (doc, article, seq, rank) of the suffixes whose first 2**k lines are shared.

    Ranks of a level sort the suffixes of a source by their first 2**k lines (a line's name holds its source, so
    sources never mix): they number the sorted distinct pairs of ranks of the level below, which is one range sort of
    distinct pairs, however many suffixes carry them. A suffix that shares its prefix with too few documents cannot
    start a longer shared block and drops out, so levels shrink and end at the longest shared block.
    """
    levels = [places.select("doc", "article", "seq", F.col("line").alias("rank"))]
    while True:
        now, half = levels[-1], 1 << (len(levels) - 1)
        after = now.select("doc", (F.col("seq") - half).alias("seq"), F.col("rank").alias("then"))
        pairs = stage.write(now.join(after, ["doc", "seq"]).withColumn("pair", F.xxhash64("rank", "then")), "pairs")
        good = _shared(pairs, "pair", min_docs).select("pair")
        kept = stage.write(pairs.join(good, "pair", "left_semi"), "kept")
        if not kept.limit(1).count():
            return levels
        order = stage.write(kept.select("rank", "then").distinct().orderBy("rank", "then").withColumn("next", F.monotonically_increasing_id()), "order")
        levels.append(stage.write(kept.join(order, ["rank", "then"]).select("doc", "article", "seq", F.col("next").alias("rank")), "level"))
        stage.drop(pairs)


def shared_blocks(stage: Stage, places: DataFrame, min_docs: int) -> DataFrame:
    """(doc, article, seq, n_lines, block): from each suffix a block of lines shared by enough documents.

    The common prefix grows from the largest level down, as in binary lifting. The first level that holds the suffix
    is accepted, as all names of a level are shared; then a prefix is followed by a smaller level's name at its end and
    stays longer if the joint name is shared by enough documents that came to the same prefix. Every suffix of the
    first level therefore has a block of one line at least.
    """
    levels = suffix_levels(stage, places, min_docs)
    found = levels[0].select("doc", "article", "seq", F.lit(0).alias("n_lines"), F.lit(0).cast("long").alias("block"))
    for k in range(len(levels) - 1, -1, -1):
        tail = levels[k].select("doc", F.col("seq").alias("at"), F.col("rank").alias("tail"))
        tried = found.withColumn("at", F.col("seq") + F.col("n_lines")).join(tail, ["doc", "at"], "left")
        tried = tried.withColumn("joint", F.when(F.col("tail").isNotNull(), F.xxhash64("block", "tail", F.lit(k))))
        if k < len(levels) - 1:
            tried = stage.write(tried, "tried")
            good = _shared(tried.filter("joint is not null and n_lines > 0"), "joint", min_docs).select("joint", F.lit(True).alias("good"))
            tried = tried.join(good, "joint", "left")
        else:
            tried = tried.withColumn("good", F.lit(False))
        longer = F.col("joint").isNotNull() & (F.coalesce(F.col("good"), F.lit(False)) | (F.col("n_lines") == 0))
        found = stage.write(
            tried.select("doc", "article", "seq", F.when(longer, F.col("n_lines") + (1 << k)).otherwise(F.col("n_lines")).alias("n_lines"), F.when(longer, F.col("joint")).otherwise(F.col("block")).alias("block")),
            "found",
        )
    return found


def _places(stage: Stage, docs: DataFrame, id_col: str, source: str, body: str, min_docs: int) -> DataFrame:
    """The rows of ``line_table`` whose line stands in enough articles of its source."""
    lines = stage.write(line_table(docs, id_col, source, body), "lines")
    often = lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("line")
    some = stage.write(lines.join(often, "line", "left_semi").distinct(), "some")
    good = _shared(some, "line", min_docs).select("line")
    places = stage.write(some.join(good, "line", "left_semi"), "places")
    stage.drop(lines)
    return places


def _version_lines(docs: DataFrame, id_col: str, source: str, body: str, min_docs: int, min_lines: int) -> DataFrame:
    """(doc, id, line_no): ``site_lines`` of each version of a document; doc is the version's name in ``line_table``."""
    stage = Stage(docs.sparkSession, "sitelines")
    places = _places(stage, docs, id_col, source, body, min_docs)
    blocks = shared_blocks(stage, places, min_docs).filter(F.col("n_lines") >= min_lines)
    covered = blocks.select("doc", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("n_lines") - 1)).alias("seq")).distinct()
    return places.join(covered, ["doc", "seq"], "left_semi").select("doc", "id", "line_no")


def site_lines(docs: DataFrame, id_col: str, source: str = "source", body: str = "body", min_docs: int = 5, min_lines: int = 1) -> DataFrame:
    """(id, line_no), distinct: lines inside blocks of ``min_lines`` lines or more shared by ``min_docs`` articles of a source.

    Lines agree after ``normal_line``; headings and lines without a letter never count and end a block, blank lines do
    neither. Repeated rows and versions of one article count once. Nulls and empty bodies give nothing. Only names
    (64-bit hashes of source and line) are shuffled: first a count of all names, which the map side combines, so that
    what occurs too rarely leaves before any sort; a source with a third of all rows is spread by line names.
    """
    return _version_lines(docs, id_col, source, body, min_docs, min_lines).select(F.col("id").alias(id_col), "line_no").distinct()


def repeated_blocks(docs: DataFrame, id_col: str, source: str = "source", body: str = "body", min_docs: int = 5, min_lines: int = 2) -> DataFrame:
    """(id, line_no, n_lines), distinct: where a block of ``min_lines`` lines or more starts that ``min_docs`` articles of a source share.

    A block that is the tail of a longer one of the same document is left out. line_no is its first line; blank lines
    within it are not counted in n_lines.
    """
    stage = Stage(docs.sparkSession, "blocks")
    places = _places(stage, docs, id_col, source, body, min_docs)
    blocks = stage.write(shared_blocks(stage, places, min_docs).filter(F.col("n_lines") >= min_lines), "blocks")
    before = blocks.select("doc", (F.col("seq") + 1).alias("seq"), (F.col("n_lines") - 1).alias("longer"))
    heads = blocks.join(before, ["doc", "seq"], "left").filter(F.coalesce(F.col("longer") < F.col("n_lines"), F.lit(True)))
    found = heads.join(places.select("doc", "seq", "id", "line_no"), ["doc", "seq"])
    return found.select(F.col("id").alias(id_col), "line_no", "n_lines").distinct()


def without_site_lines(docs: DataFrame, id_col: str, source: str = "source", body: str = "body", min_docs: int = 5, min_lines: int = 1) -> DataFrame:
    """``docs`` with the lines that ``site_lines`` finds taken out of each body; all rows and columns stay.

    The numbers of a document's lines come back to it as one array, at most as long as the document. Versions of one id
    with different bodies or sources each lose their own lines only.
    """
    found = _version_lines(docs, id_col, source, body, min_docs, min_lines).groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(found, F.xxhash64(id_col, body, source) == F.col("__doc"), "left")
    numbered = F.transform(F.split(F.col(body), "\n"), lambda t, i: F.struct((i + 1).alias("no"), t.alias("text")))
    kept = F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("__gone"), s["no"])), lambda s: s["text"])
    return joined.withColumn(body, F.when(F.col("__gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n"))).drop("__doc", "__gone")
