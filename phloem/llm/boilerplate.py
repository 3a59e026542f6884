"""Page boilerplate against main content: template deduction from equivalence classes of tokens.

Pages of one host are printed from one template. A token (a line with its variable parts masked, or a line's leading
label) that the template prints occurs in the same pages, as often, and in the same order as its companions; an
article's own lines do not. Tokens are therefore grouped by their occurrence vector over the host's pages, classes are
validated by support and order, the valid ones nest into the template by the gaps that they occur in, and what is left
between them are slots: the article's slot is kept, slots that open inside a block of furniture are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phloem.storage import Stage

_LINK = re.compile(r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]\([^()\s]*\)")
_DIGITS, _STARS, _SPACE = re.compile(r"[0-9]+"), re.compile("[★☆]+"), re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_LABEL = re.compile(r"^((?:[^\w\s#|<\\{]{0,3}\s?)(?:[^\W\d_]+ ){0,3}[^\W\d_]+:[*_]{0,2})\s*\S")
_MARK = re.compile(r"^(>>+|»+|→+|›+|▶+|►+|☞+)\s*\S")
_PROSE_END = re.compile(r"[.!?…)”\"]\s*$")
_HEADING = re.compile(r"#{1,6}\s")
_REFERENCE = re.compile(r"^(?:[-*+]|\d+[.)]|\[\d+\])\s+[^\[\]]{3,}\[")

#: What a line is by itself: other, prose, heading, the page's title, part of a code block, formula or table.
OTHER, PROSE, HEADING, TITLE, BLOCK = range(5)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def frame(line: str, title: str | None) -> str:
    """The line with its variable parts masked: the page's title, link labels and targets, digits, stars, blanks."""
    line = line.strip()
    if title and not line.startswith("#"):
        line = line.replace(title, "⟨T⟩")
    if not line.startswith("!["):
        line = _LINK.sub("[L](U)", line)
    return _SPACE.sub(" ", _STARS.sub("★", _DIGITS.sub("0", line)))


def label(framed: str) -> str | None:
    """A leading label such as ``See also:`` or ``>>`` that a template may print before a variable part."""
    if framed.startswith(("#", "> ")):
        return None
    found = _LABEL.match(framed) or _MARK.match(framed)
    return found.group(1).strip() if found else None


class Line:
    """What a line is by itself: text without outer blanks, what it opens, kind, whether it is a reference, token, label token."""

    __slots__ = ("text", "opens", "kind", "reference", "token", "label", "hashes")

    def __init__(self, line: str, title: str | None):
        self.text = text = line.strip()
        self.opens, self.kind, self.reference, self.token, self.label, self.hashes = "", OTHER, False, None, None, None
        if text.startswith(("```", "~~~")):
            self.opens = "fence"
        elif text == "$$":
            self.opens = "formula"
        elif text.startswith(("|", "{|")):
            self.opens = "table"
        elif text:
            self.opens = "title" if text.startswith("# ") else ""
            framed = frame(text, title)
            heading = _HEADING.match(text)
            self.kind = HEADING if heading else PROSE if len(framed) > 160 or (len(framed) > 60 and " " in framed and _PROSE_END.search(framed)) else OTHER
            self.token = framed if _LETTER.search(framed.replace("⟨T⟩", "").replace("[L](U)", "a" * ("[L](U)" in framed))) else None
            self.label = None if heading else label(framed)
            self.reference = bool(_REFERENCE.match(text))

    def names(self, before: bool) -> tuple[int | None, int | None]:
        """Hashes of token and label in their role; what stands before the title and after it are two tokens."""
        if self.hashes is None:
            self.hashes = {}
        if before not in self.hashes:
            gap = "1" if before else "0"
            self.hashes[before] = (None if self.token is None else _hash(gap + self.token), None if self.label is None else _hash(gap + "label " + self.label))
        return self.hashes[before]


class Lines:
    """Lines read before, up to a bound; a line that holds the page's title depends on it and is read anew."""

    def __init__(self, most: int = 200_000):
        self._known: dict[str, Line] = {}
        self._most = most

    def get(self, line: str, title: str | None) -> Line:
        if title and title in line:
            return Line(line, title)
        known = self._known.get(line)
        if known is None:
            known = Line(line, None)
            if len(self._known) < self._most and len(line) < 1000:
                self._known[line] = known
        return known


def read_page(markdown: str, title: str | None, lines: Lines | None = None) -> list[tuple[int, int, int, Line]]:
    """Non-blank lines: (line_no, block, kind, what the line is by itself). A block ends at a blank line."""
    lines = lines or Lines()
    out, block, inside, titled = [], 0, "", False
    for no, line in enumerate(markdown.split("\n"), 1):
        read = lines.get(line, title)
        if not read.text:
            block += 1
            continue
        kind = read.kind
        if read.opens == "fence":
            inside = {"": "fence", "fence": ""}.get(inside, inside)
            kind = BLOCK
        elif inside == "fence" or read.opens == "table":
            kind = BLOCK
        elif read.opens == "formula":
            inside = "" if inside == "formula" else "formula"
            kind = BLOCK
        elif inside:
            kind = BLOCK
        elif read.opens == "title" and not titled:
            titled = True
            kind = TITLE
        out.append((no, block, kind, read))
    return out


_READ = "key long, host string, page long, lines array<struct<line_no:int,block:int,kind:int,follow:int,token:long,label:long,above:long,above_label:long>>"


_FIELDS = ("line_no", "block", "kind", "follow", "token", "label", "above", "above_label")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Lines()
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            columns: list[list] = [[] for _ in _FIELDS]
            ends = [0]
            for title, markdown in zip(batch.column("title").to_pylist(), batch.column("markdown").to_pylist()):
                lines = read_page(markdown, title if title is not None and len(title) > 3 else None, known)
                before = any(x[2] == TITLE for x in lines)
                above = (None, None, None)  # block, token and label of a line that the next one of its block runs on from
                for at, (no, block, kind, line) in enumerate(lines):
                    if kind == TITLE:
                        before = False
                    plain = kind < TITLE
                    nxt = lines[at + 1] if at + 1 < len(lines) else None
                    # what a heading opens: 1 a list or line of the same block that is no reference, 0 anything else
                    follow = int(nxt is not None and nxt[1] == block and nxt[2] == OTHER and not nxt[3].reference)
                    names = line.names(before) if plain else (None, None)
                    row = (no, block, kind + 8 * before + 16 * (plain and line.reference), follow, *names, *(above[1:] if above[0] == block else (None, None)))
                    for column, value in zip(columns, row):
                        column.append(value)
                    above = (block if kind in (OTHER, PROSE) else None, *names)
                ends.append(len(columns[0]))
            kinds = [pa.int32()] * 4 + [pa.int64()] * 4
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(_FIELDS))
            read = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("page"), read], names=["key", "host", "page", "lines"])


def deduce_template(stage: Stage, pages: DataFrame, min_pages: int) -> DataFrame:
    """(host, token): the tokens of the valid classes of each host's template, from the pages that ``_read`` gave.

    One row a host, page and token, with the token's count and first place; then the occurrence vector of a token is
    hashed as a sum over its pages, so nothing of a host is gathered in one task however many pages it has. Tokens with
    the same vector that nest in the same gap are a class; where their order differs between pages the class fails and
    its tokens stand or fall alone. A token's role depends on the gaps of the one token that every page has, its title:
    before and after it are two tokens. After the title, the article's slot ends with the page's last prose line that
    the host does not repeat. A class is valid if ``min_pages`` of the host's distinct pages hold it, however many it has, and it nests in a gap
    outside that slot on most of them; inside the slot it is valid only as an insert, none of whose tokens is prose or
    runs on from a line of the article in the same block. A heading counts only where it opens a list or line directly
    on most pages, which an article's headings do not. A token valid for three hosts or more is also taken as template
    of all others (host null), which serves hosts with too few pages to deduce anything.
    """
    lines = pages.select("host", "page", F.explode("lines").alias("l")).select(
        "host", "page", F.col("l.line_no").alias("seq"), "l.kind", "l.follow", "l.label", "l.above", "l.above_label", F.explode(F.array("l.token", "l.label")).alias("token")
    )
    each = lines.filter("token is not null")
    at = lambda c: F.min_by(c, "seq").alias(c)
    per_page = each.groupBy("host", "token", "page").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max(F.when(F.col("kind") % 8 == HEADING, 1).otherwise(0)).alias("heading"), F.max("follow").alias("follow"),
        F.max(F.when(F.col("kind") % 8 == PROSE, 1).otherwise(0)).alias("prose"), F.max(F.when(F.col("kind") % 16 >= 8, 1).otherwise(0)).alias("before"), at("label"), at("above"), at("above_label"),
    )
    per_page = stage.write(per_page, "tokens")
    tokens = (
        per_page.groupBy("host", "token")
        .agg(
            F.count("*").alias("support"),
            F.sum(F.shiftright(F.xxhash64("page", "n"), 20)).alias("vector"),
            F.max("heading").alias("heading"),
            F.avg("follow").alias("follow"),
        )
        .filter(F.col("support") >= min_pages)
        .select("host", "token", "vector", "support", "heading", "follow")
    )
    tokens = stage.write(tokens, "repeated")
    repeated = lambda c: tokens.select("host", F.col("token").alias(c), F.lit(True).alias(f"{c}_repeated"))
    own_prose = per_page.filter("prose = 1 and before = 0").join(tokens.select("host", "token"), ["host", "token"], "left_anti").join(repeated("label"), ["host", "label"], "left_anti")
    ends = own_prose.groupBy("host", "page").agg(F.max("last").alias("end"))
    placed = per_page.drop("heading", "follow").join(tokens.filter("heading = 0 or follow > 0.5"), ["host", "token"])
    placed = placed.join(ends, ["host", "page"], "left").join(repeated("above"), ["host", "above"], "left").join(repeated("above_label"), ["host", "above_label"], "left")
    runs_on = F.col("above").isNotNull() & F.col("above_repeated").isNull() & F.col("above_label_repeated").isNull()
    inside = (F.col("before") == 0) & F.coalesce(F.col("first") < F.col("end"), F.lit(False))
    share = lambda c: F.avg(c.cast("int")) > 0.5
    nested = placed.groupBy("host", "token").agg(
        F.max("before").alias("before"), share(inside).alias("inside"), (F.max("heading") == 1).alias("heading"), share(F.col("prose") == 1).alias("prose"), share(runs_on).alias("runs_on")
    )
    nested = stage.write(nested.withColumn("own_text", ~F.col("heading") & (F.col("prose") | F.col("runs_on"))).select("host", "token", "before", "inside", "own_text"), "nested")
    group = ["host", "vector", "support", "before", "inside"]
    ranked = placed.select("host", "token", "page", "first", "vector", "support").join(nested.select("host", "token", "before", "inside"), ["host", "token"])
    rank = F.row_number().over(Window.partitionBy("page", *group).orderBy("first", "token"))
    ordered = ranked.withColumn("rank", rank).groupBy("token", *group).agg((F.min("rank") == F.max("rank")).alias("ordered"))
    classes = ordered.withColumn("ordered", F.min("ordered").over(Window.partitionBy(*group))).join(nested.select("host", "token", "own_text"), ["host", "token"])
    classes = classes.withColumn("class_id", F.when(F.col("ordered"), F.xxhash64("vector", "support")).otherwise(F.col("token")))
    valid = ~F.col("inside") | ~F.max("own_text").over(Window.partitionBy("host", "class_id", "before", "inside"))
    own = classes.withColumn("valid", valid).filter("valid").select("host", "token")
    everywhere = own.groupBy("token").agg(F.countDistinct("host").alias("hosts")).filter("hosts >= 3")
    return own.union(everywhere.select(F.lit(None).cast("string"), "token"))


def _classify(lines: list, hits: set[int]) -> list[int]:
    """Line numbers outside the article, of one page's lines; ``hits`` are the lines that the template prints."""
    out: list[int] = []
    previous, furniture = None, False
    for line_no, block, kind, follow in lines:
        before, reference, kind = bool(kind & 8), bool(kind & 16), kind & 7
        if kind == TITLE or kind == BLOCK and not before:
            now = False
        elif before or (line_no in hits and kind != HEADING):
            now = True  # the slot before the title, and the template itself
        elif kind == HEADING:
            now = line_no in hits and bool(follow)
        else:
            now = previous == block and furniture and kind == OTHER and not reference  # a slot inside a block of furniture
        if now:
            out.append(line_no)
        previous, furniture = block, now
    return out


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, hits = batch.column("lines"), batch.column("hits")
        starts, flat = lines.offsets.to_pylist(), lines.values
        fields = list(zip(*[flat.field(f).to_pylist() for f in _FIELDS[:4]])) if len(flat) else []
        keys, gone = [], []
        for i, (key, found) in enumerate(zip(batch.column("key").to_pylist(), hits.to_pylist())):
            out = _classify(fields[starts[i] : starts[i + 1]], set(found or ()))
            gone += out
            keys += [key] * len(out)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.int32())], names=["key", "line_no"])


def boilerplate_lines(
    pages: DataFrame, id_col: str, markdown: str = "markdown", title: str = "title", url: str = "url", source: str = "source", min_pages: int = 4
) -> DataFrame:
    """(id, line_no), distinct: every non-blank line of a page's Markdown outside its article. Lines count from 1.

    Pages belong to the host of their url, or to their source where the url has none; the same url crawled again is
    one page in the counts, and pages with neither are one host of their own pages. Null or blank Markdown has no
    lines. A null title only means that nothing is masked. A page without a title line keeps no slot before the title.
    Repeated rows give their lines once. A page's lines stay together in one row, so only tokens are ever shuffled by host. Very long pages are read whole; a page is the largest unit in one task.
    """
    spark = pages.sparkSession
    stage = Stage(spark, "boilerplate")
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://([^/?#]+)", 1)), F.lit("")), F.col(source), F.lit(""))
    keyed = pages.filter(F.col(markdown).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.xxhash64(id_col, markdown, title, url).alias("key"),
        host.alias("host"),
        F.xxhash64(F.coalesce(F.col(url), F.col(markdown))).alias("page"),
        F.col(title).alias("title"),
        F.col(markdown).alias("markdown"),
    )
    read = stage.write(keyed.select("key", "host", "page", "title", "markdown").mapInArrow(_read, _READ), "pages")
    template = stage.write(deduce_template(stage, read, min_pages), "template")
    local = template.filter("host is not null").select("host", "token", F.lit(True).alias("hit"))
    anywhere = template.filter("host is null").select("token", F.lit(True).alias("any"))
    lines = read.select("key", "host", F.explode("lines").alias("l"))
    tokens = lines.select("key", "host", "l.line_no", F.explode(F.array("l.token", "l.label")).alias("token")).filter("token is not null")
    hits = tokens.join(local, ["host", "token"], "left").join(anywhere, "token", "left").filter("hit or any").groupBy("key").agg(F.collect_set("line_no").alias("hits"))
    decided = read.select("key", "lines").join(hits, "key", "left").mapInArrow(_decide, "key long, line_no int")
    return keyed.select("id", "key").distinct().join(decided, "key").select(F.col("id").alias(id_col), "line_no").distinct()
