"""Documents: Markdown cleaning, sections and token-budgeted chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phloem.functions import text as t

# Lines that a crawler leaves behind.
NOISE = (
    "^ĐẶT LỊCH HẸN$", "^XEM HỒ SƠ$", "^Tư vấn chuyên môn bài viết$", "^Cập nhật lần cuối:", "^Chia sẻ:", "^BÀI VIẾT LIÊN QUAN$",
    "^BÀI VIẾT CÙNG CHỦ ĐỀ$", "^ĐĂNG KÝ NHẬN TIN$", "^ĐỐI TÁC BẢO HIỂM$", "^Copyright",
)
# Fixed value: what the part before the first heading is called.
SUMMARY = "Tóm tắt"


# Plain lines that are headings, as patterns of a whole line without case.
PLAIN_HEADINGS = (
    r"^.+ là gì\?$", "^Triệu chứng .+", "^Dấu hiệu .+", "^Nguyên nhân .+", "^Các biến chứng .+", "^Biến chứng .+", "^Chẩn đoán .+", "^Cách điều trị .+", "^Điều trị .+",
    "^Cách phòng ngừa .+", "^Phòng ngừa .+", "^Một số câu hỏi thường gặp$", "^Câu hỏi thường gặp$", r"^Khi nào cần gặp bác sĩ\?$",
)
# What ends a page's content. A site's own markers are passed beside these.
STOPS = (
    "\n- Fanpage:", "\n- Website:", "\nCập nhật lần cuối:", "\nChia sẻ:", "\n**Nguồn tham khảo**", "\nNguồn tham khảo", "\nChủ đề:", "\n### BÀI VIẾT LIÊN QUAN", "\n## BÀI VIẾT LIÊN QUAN",
    "\n### BÀI VIẾT CÙNG CHỦ ĐỀ", "\n## BÀI VIẾT CÙNG CHỦ ĐỀ", "\nĐĂNG KÝ NHẬN TIN", "\n## ĐỐI TÁC BẢO HIỂM", "\nCopyright ©",
)
# Whole lines, beginnings and parts of lines that a page's content does not hold.
USELESS_LINES = ("Mục lục", "ĐẶT LỊCH HẸN", "XEM HỒ SƠ", "Tư vấn chuyên môn bài viết")
NOISE_STARTS = ("Xem thêm:", "Tìm hiểu thêm:", "Tham khảo thêm:", "Xem chi tiết:", "Cập nhật lần cuối:", "Chia sẻ:", "Chủ đề:", "Hotline:", "Fanpage:", "Website:", "Địa chỉ:")
NOISE_PARTS = (
    "ĐẶT LỊCH HẸN", "XEM HỒ SƠ", "Tổng đài tư vấn", "Quý khách vui lòng", "Để đặt lịch khám", "BÀI VIẾT LIÊN QUAN", "BÀI VIẾT CÙNG CHỦ ĐỀ", "ĐĂNG KÝ NHẬN TIN", "ĐỐI TÁC BẢO HIỂM", "Copyright",
)


def _tidy(lines: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))


def promote_headings(markdown: Column) -> Column:
    """Plain lines that read like a heading, of at most 14 words, as second-level headings; numbered ones as third-level."""
    known = "(?iu)" + "|".join(PLAIN_HEADINGS)

    def one(x: Column) -> Column:
        line = F.trim(x)
        short = (line != "") & ~line.startswith("#") & (_words(line) <= 14)
        return F.when(short & line.rlike(known), F.concat(F.lit("## "), line)).when(short & line.rlike(r"^\d+\.\s+.+"), F.concat(F.lit("### "), line)).otherwise(x)

    return _tidy(F.transform(F.split(markdown, "\n"), one))


def cut_at(markdown: Column, stops: tuple[str, ...] = STOPS) -> Column:
    """What stands before the first of the markers."""
    at = F.array_min(F.array(*[F.when(F.locate(m, markdown) > 0, F.locate(m, markdown)) for m in stops]))
    return F.regexp_replace(F.when(at.isNotNull(), F.substring(markdown, F.lit(1), at - 1)).otherwise(markdown), r"^\s+|\s+$", "")


def compared(line: Column) -> Column:
    """A heading or title for comparison, in lower case."""
    return F.lower(t.collapse(F.regexp_replace(F.regexp_replace(F.trim(line), r"^#{1,6}\s+", ""), r"\*|_", "")))


def without_intro(markdown: Column, title: Column, useless: tuple[str, ...] = USELESS_LINES) -> Column:
    """Without the title's first repetition in the first 20 lines, dates that stand alone in the first 30 and useless lines in the first 60."""
    lines = F.split(markdown, "\n")
    same = F.transform(lines, lambda x, i: (compared(title) != "") & (i < 20) & (compared(x) == compared(title)))
    first = F.array_position(same, F.lit(True))
    line = lambda x: t.collapse(x)
    kept = F.filter(lines, lambda x, i: ~((i + 1 == first) | ((i < 30) & line(x).rlike(r"^\d{2}/\d{2}/\d{4}$")) | ((i < 60) & line(x).isin(*useless))))
    return _tidy(F.transform(kept, lambda x: F.when(line(x) == "", F.lit("")).otherwise(x)))


def noise_line(line: Column) -> Column:
    """Whether a trimmed line is left over from a page's furniture: a known line, beginning or part, or nothing but a link."""
    starts = line.rlike("^(?:" + "|".join(rf"\Q{s}\E" for s in NOISE_STARTS) + ")")
    return line.isin(*USELESS_LINES) | starts | t.contains_any(line, NOISE_PARTS) | line.rlike(r"^\[[^\]]*\]\([^)]*\)$")


def clean_pages(pages: DataFrame, markdown: str = "markdown", title: str = "title") -> DataFrame:
    """``pages`` with their Markdown after all steps: intro, headings, cut, then noise lines and repetitions of the title's heading.

    Each step is a column of its own, so that it is worked out once. Null Markdown stays null.
    """
    named = F.coalesce(F.col(title), F.lit(""))
    steps = pages.withColumn("__a", without_intro(F.col(markdown), named)).withColumn("__b", promote_headings(F.col("__a"))).withColumn("__c", cut_at(F.col("__b")))
    lines = steps.withColumn("__head", compared(named)).withColumn("__l", F.split("__c", "\n"))
    is_title = lambda x: F.trim(x).startswith("# ") & (F.col("__head") != "") & (compared(x) == F.col("__head"))
    marked = lines.withColumn("__first", F.array_position(F.transform("__l", is_title), F.lit(True)))
    kept = F.filter("__l", lambda x, i: (F.trim(x) == "") | (~noise_line(F.trim(x)) & ((i + 1 == F.col("__first")) | ~is_title(x))))
    out = _tidy(F.transform(kept, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x)))
    return marked.withColumn(markdown, out).drop("__a", "__b", "__c", "__head", "__l", "__first")


def normal_newlines(c: Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(one, r"^\s+|\s+$", "")


def clean_body(body: Column, title: Column) -> Column:
    """One newline form, at most one blank line in a row, the title's heading once, no crawler lines. All in one row expression."""
    lines = F.split(normal_newlines(body), "\n")
    is_title = lambda x: F.trim(x).startswith("# ") & (t.heading_key(x) == t.heading_key(title))
    first = F.array_position(F.transform(lines, lambda x: F.coalesce(is_title(x), F.lit(False))), F.lit(True))
    noise = "(?iu)" + "|".join(NOISE)
    kept = F.filter(lines, lambda x, i: ~F.trim(x).rlike(noise) & ((i + 1 == first) | ~F.coalesce(is_title(x), F.lit(False))))
    return normal_newlines(F.array_join(kept, "\n"))


def sections(articles: DataFrame, id_col: str = "article_id", title: str = "title", body: str = "body") -> DataFrame:
    """(article_id, order, section_id, section_title, section_level, parent, text): Markdown cut at its headings.

    The title's own first-level heading is left out; text before any heading is the summary; sections without text are
    left out and do not count in ``order``. A third-level heading or deeper has the last second-level one as parent; a
    first-level heading keeps the parent that was current, and a second-level one clears it. Windows run within one
    article, the largest unit.
    """
    rows = articles.select(F.col(id_col).alias("article_id"), F.col(title).alias("title"), F.posexplode(F.split(F.col(body), "\r\n|[\n\r]")).alias("pos", "line"))
    mark = F.regexp_extract(F.trim("line"), r"^(#{1,6})\s+\S", 1)
    name = F.trim(F.regexp_replace(F.regexp_extract(F.trim("line"), r"^#{1,6}\s+(.+?)\s*$", 1), r"\*\*|__", ""))
    read = rows.withColumns({"level": F.length(mark), "heading": name}).filter(~F.coalesce((F.col("level") == 1) & (F.col("heading") == F.col("title")), F.lit(False)))
    upto = Window.partitionBy("article_id").orderBy("pos")
    marked = read.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(upto))
    above = F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(upto)
    ruled = F.last(F.when(F.col("level") >= 2, F.struct(F.when(F.col("level") >= 3, F.col("above")).alias("parent"))), ignorenulls=True).over(upto)
    full = marked.withColumn("above", above).withColumn("parent", ruled.getField("parent"))
    text_lines = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line"))))
    grouped = full.groupBy("article_id", "part").agg(
        F.max(F.when(F.col("level") > 0, F.col("heading"))).alias("section_title"),
        F.max("level").alias("section_level"),
        F.max(F.when(F.col("level") > 0, F.struct(F.col("parent").alias("p")))).getField("p").alias("parent"),
        F.regexp_replace(F.array_join(F.transform(text_lines, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("text"),
    )
    some = grouped.filter("text <> ''").withColumn("order", F.row_number().over(Window.partitionBy("article_id").orderBy("part")) - 1)
    named = some.withColumns({"section_title": F.coalesce("section_title", F.lit(SUMMARY)), "section_level": F.when(F.col("section_level") > 0, F.col("section_level")).otherwise(2)})
    return named.select("article_id", "order", t.stable_id("section", "article_id", "order", "section_title").alias("section_id"), "section_title", "section_level", "parent", "text")


def words_and_half(text: str) -> int:
    return int(len(text.split()) * 1.5)


def split_sentences(text: str, budget: int, size: Callable[[str], int] = words_and_half) -> list[str]:
    """Sentences joined as long as they fit the budget; one that does not fit stands alone."""
    out: list[str] = []
    for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?。])\s+", text.strip()))):
        if out and size(f"{out[-1]} {sentence}") <= budget:
            out[-1] = f"{out[-1]} {sentence}"
        else:
            out.append(sentence)
    return out


def split_paragraphs(text: str, budget: int, overlap: int = 1, size: Callable[[str], int] = words_and_half) -> list[str]:
    """Paragraphs joined as long as they fit; a new part repeats the last ``overlap`` paragraphs of the one before.

    A part that does not fit even so is cut by sentences, and the next paragraph may still join the last piece.
    """
    parts: list[list[str]] = []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not paragraph:
            continue
        if parts and size("\n\n".join([*parts[-1], paragraph])) <= budget:
            parts[-1].append(paragraph)
            continue
        fresh = "\n\n".join([*(parts[-1][-overlap:] if parts and overlap else []), paragraph])
        parts += [[x] for x in split_sentences(fresh, budget, size)] if size(fresh) > budget else [fresh.split("\n\n")]
    return ["\n\n".join(p) for p in parts]


def _under_headings(sections: list[dict]) -> str:
    return "\n\n".join(f"{'#' * min(6, max(2, s['section_level']))} {s['section_title']}\n\n{s['text'].strip()}" for s in sections)


def _in_context(title: str, sections: list[dict], text: str, single: bool) -> str:
    """The text under its article's title and its section's names, as it is embedded and extracted from."""
    names = [s["section_title"] for s in sections]
    parent = sections[0]["parent"] if single else None
    head = [f"Bài viết: {title}", *([f"Mục lớn: {parent}"] if parent else []), f"Mục: {names[0]}" if single else f"Các mục trong chunk: {' | '.join(names)}"]
    return "\n".join([*head, "", text]).strip()


def chunk_article(title: str, parts: list[dict], budget: int = 900, size: Callable[[str], int] = words_and_half) -> list[dict]:
    """Neighbouring sections packed whole into chunks while they fit; a section too long for one is split by paragraph and sentence.

    Sections are dicts of section_title, section_level, parent, text. Budgets are of the text with its context, those of
    split parts of the bare text.
    """
    runs: list[tuple[bool, list[dict]]] = []
    for s in parts:
        if not s["text"].strip():
            continue
        if size(_in_context(title, [s], s["text"].strip(), True)) > budget:
            runs.append((True, [s]))
        elif runs and not runs[-1][0] and size(_in_context(title, [*runs[-1][1], s], _under_headings([*runs[-1][1], s]), False)) <= budget:
            runs[-1][1].append(s)
        else:
            runs.append((False, [s]))
    out = []
    for long, own in runs:
        first = own[0]
        for text in split_paragraphs(first["text"], budget, 1, size) if long else [_under_headings(own)]:
            out.append(
                {
                    "section": (first["parent"] or first["section_title"]) if long else " | ".join(s["section_title"] for s in own),
                    "subsection": first["section_title"] if long and first["parent"] else None,
                    "text": text.strip(),
                    "contextualized_text": _in_context(title, own, text.strip(), long),
                    "n_sections": len(own),
                }
            )
    return out


_CHUNK = "chunk_id string, article_id string, chunk_index int, section string, subsection string, text string, contextualized_text string, token_count int, n_sections int"


def chunks(sectioned: DataFrame, titles: DataFrame, budget: int = 900) -> DataFrame:
    """Chunks of all articles; each article's sections come together in one row, the largest unit of a task."""
    parts = sectioned.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("order", "section_title", "section_level", "parent", "text"))).alias("parts"))
    rows = parts.join(titles.select("article_id", "title"), "article_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for article, parts, title in zip(batch["article_id"], batch["parts"], batch["title"]):
                for i, c in enumerate(chunk_article(title or "", [dict(p) if isinstance(p, dict) else p.asDict() for p in parts], budget)):
                    key = hashlib.md5(f"{article}:{i}:{c['text'][:120]}".encode()).hexdigest()[:12]
                    found.append((f"chunk_{key}", article, i, c["section"], c["subsection"], c["text"], c["contextualized_text"], words_and_half(c["contextualized_text"]), c["n_sections"]))
            yield pd.DataFrame(found, columns=[f.split()[0] for f in _CHUNK.split(", ")])

    return rows.mapInPandas(run, _CHUNK)


def links(c: Column, limit: int | None = None) -> Column:
    """Targets of Markdown links in order, each once."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\]\((https?://[^()\s]+)\)"), F.lit(1)))
    return found if limit is None else F.slice(found, 1, limit)
