"""Markup residue: lines with foreign markup, and clean Markdown made of them.

Texts are read as flat blocks, one a line. A block is described by its markup counts, its own word count and link
density and those of its neighbours, and is classified by one decision tree a kind of markup, trained on the small
labelled table below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.llm.tree import Tree

KINDS = ("html", "wiki", "latex")

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_MATH = re.compile(r"\$\$[^$]+\$\$|(?<![\\$])\$(?=[^\s$])[^$]*?[^\s$\\]\$(?![\d$])")
_TRIGGER = re.compile(r"[<&{}\[\]\\=|!'_]|--")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[^<>]*|\s*/?)>|<![A-Za-z][^<>]*>")
_TAG_PART = re.compile(r"<(?:div|p|span|table|tr|td|th|a|img|ul|ol|li|font|iframe|script|style|form|input|br|section|figure)\s[^<>]*$", re.IGNORECASE)
_REF = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_ESCAPED = re.compile(r"&lt;/?[A-Za-z!]")
_WIKI_LINK = re.compile(r"\[\[(?!\^?\d+\]\]?\()[^\[\]]+(?:\]\]|$)|^[^\[\]]*\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*(?:\}\}|$)")
_WIKI_QUOTE = re.compile(r"'{2,5}[^'\n]+'{2,5}")
_WIKI_HEADING = re.compile(r"^\s*(={2,6}).*\1\s*$")
_WORD = re.compile(r"\S*\w\S*")
_WIKI_EXTERNAL = re.compile(r"(?<!\[)\[(?:https?:)?//[^\s\]]+(?: [^\]]*)?\](?![(\[])")
_WIKI_WORD = re.compile(r"__[A-Z]{3,}__|^\s*#(?:REDIRECT|redirect)\b|~{4}")
_LATEX = re.compile(r"\\(?:begin|end)\s*\{[A-Za-z*]+\}|(?<![A-Za-z0-9:\\])\\[A-Za-z]+\*?(?![A-Za-z\\])|(?<=[A-Za-z0-9])\\[A-Za-z]+\*?(?=\{)")
_ENV = re.compile(r"\\(begin|end)\s*\{([A-Za-z*]+)\}")
_LINKED = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)|https?://\S+")

#: Names of the features of a block, in order.
FEATURES = (
    "tags", "references", "in_comment", "wiki_links", "templates", "quotes", "wiki_heading", "external", "magic", "in_wiki_table", "in_template",
    "commands", "in_environment", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
)


def _size(line: str) -> tuple[int, float]:
    """Words of a line that hold a letter or digit, and the share of them inside links."""
    words = len(_WORD.findall(line))
    if not words or ("](" not in line and "://" not in line):
        return words, 0.0
    return words, min(1.0, sum(len((m.group(1) or "x").split()) for m in _LINKED.finditer(line)) / words)


def visible(lines: list[str]) -> list[str | None]:
    """Each line without inline code and formulas; None for lines of fenced code and of formulas between ``$$`` lines."""
    out: list[str | None] = []
    fence, formula = "", False
    for line in lines:
        found = _FENCE.match(line)
        if fence:
            out.append(None)
            if found and found.group(1).startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if found and not formula:
            fence = found.group(1)
            out.append(None)
            continue
        if line.strip() == "$$":
            formula = not formula
            out.append(None)
            continue
        if formula:
            out.append(None)
            continue
        if "`" in line:
            line = _CODE.sub(" ", line)
        if "$" in line:
            line = _MATH.sub(" ", line)
        out.append(line)
    return out


def blocks(text: str) -> Iterator[tuple[int, list[float]]]:
    """(line number, features) of the lines that may hold markup; a state is carried over tables, comments and such."""
    lines = text.split("\n")
    seen = visible(lines)
    comment = table = template = False
    environments = 0
    sizes: dict[int, tuple[int, float]] = {}

    def size(i: int) -> tuple[int, float]:
        if not 0 <= i < len(lines):
            return 0, 0.0
        if i not in sizes:
            sizes[i] = _size(lines[i])
        return sizes[i]

    for i, line in enumerate(seen):
        if line is None or not line.strip():
            continue
        if not (comment or table or template or environments) and not _TRIGGER.search(line):
            continue
        was_comment = comment
        if "<!--" in line or "-->" in line:
            comment = line.rfind("<!--") > line.rfind("-->")
            was_comment = True
        start = line.lstrip()
        opens = start.startswith("{|")
        in_table = table or opens
        table = (table or opens) and not start.startswith("|}")
        in_template = template or line.count("{{") > line.count("}}")
        template = (template and "}}" not in line) or line.count("{{") > line.count("}}")
        in_environment = environments > 0 or "\\begin" in line
        for m in _ENV.finditer(line):
            environments = max(0, environments + (1 if m.group(1) == "begin" else -1))
        own, before, after = size(i), size(i - 1), size(i + 1)
        yield i + 1, [
            len(_TAG.findall(line)) + bool(_TAG_PART.search(line)), len(_REF.findall(line)) + len(_ESCAPED.findall(line)), float(was_comment),
            len(_WIKI_LINK.findall(line)), len(_WIKI_TEMPLATE.findall(line)), len(_WIKI_QUOTE.findall(line)), float(bool(_WIKI_HEADING.match(line))),
            len(_WIKI_EXTERNAL.findall(line)), len(_WIKI_WORD.findall(line)), float(in_table), float(in_template),
            len(_LATEX.findall(line)), float(in_environment), *own, *before, *after,
        ]


#: The labelled table: a text, and for each of its lines the kinds of markup in it ('.' none, h html, w wiki, l latex).
LABELLED = (
    ("# Viêm da cơ địa\n\nBệnh hay gặp ở trẻ nhỏ.\n\n- Ngứa về đêm\n- Khô da", "......"),
    ("<p>Người bệnh cần tái khám.</p>\n<ul>\n<li>Giữ ẩm\n<li>Tránh nắng</li>\n</ul>", "hhhhh"),
    ("Dùng thuốc theo đơn.<br/>Không tự ý ngừng.\n<b>Lưu ý</b> khi có thai.\nHuyết áp <120/80 và >90, p < 0,05 [1].", "hh."),
    ("Người&nbsp;bệnh cần nghỉ ngơi\nnh&#x1EB9; và v&#7915;a\nA &amp; B, từ 5 &ge; 3\nNghiên cứu & thử nghiệm", "hhh."),
    ("&lt;p&gt;Đoạn bị thoát&lt;/p&gt;\n<!-- ghi chú -->\nĐoạn thường sau ghi chú.\n<!-- mở\nvẫn trong ghi chú\nđóng -->", "hh.hhh"),
    ('<div class="box"><p>Một đoạn dài trong khung.</p></div>\n<table>\n<tr><td>ho</td><td>nặng</td></tr>\n</table><!--x-->\n| cột | mức |\n|---|---|', "hhhh.."),
    ("<P ALIGN=left>Chữ hoa\nCâu thường & dài, 3 * 6.\n<img src=\"a.png\">\nXem <https://vidu.example> để rõ.\n<span style=\"x\">màu</span>", "h.h.h"),
    ("mg/m<sup>3</sup> mỗi ngày\n5 < 7 và a > b\nCâu có <a href=\"https://vidu.example\">liên kết</a>.\nBộ mã {a; b} và do_am_1.\n<em>Tham vấn</em>", "h.h.h"),
    ("== Nguyên nhân ==\n'''Viêm''' là bệnh ''mạn tính''.\nXem [[Viêm da|bài này]].\n{{chú thích|tác giả=A|năm=2001}}\nCâu thường.", "wwww."),
    ('{| class="wikitable"\n! Tên !! Mức\n|-\n| ho || nặng\n|}\n\n| a | b |\n|---|---|\n| 1 | 2 |', "wwwww...."),
    ("=== Điều trị ===\nThuốc bôi [https://vidu.example/a trang này] mỗi ngày.\nXem [trang này](https://vidu.example/a).\n[[Tập tin:a.jpg|nhỏ|Hình một]]\n![hình](a.png)", "ww.w."),
    ("{{Thông tin\n| tên = Viêm\n| nhóm = da\n}}\nCâu thường ''nghiêng'' ở đây.\nGóc 5' và 10'' là đủ.", "wwwww."),
    ("Nguyên nhân\n===========\nCâu thường.\n\nBiểu hiện\n======\nChia hai cột a == b.\n==Mục==\n==== Mục sâu hơn ====\n====\nHết.", ".......ww.."),
    ("__TOC__\n'''Đậm'''\nxyz [[liên kết]] cuối.\nDanh sách [1], [2–4].\n[//vidu.example nhãn] sau.\nKết thúc.", "www.w."),
    ('{| border="1"\n|-\n! Thuốc\n| viên\n| gói || lọ\n|}', "wwwwww"),
    ("\\section{Mở đầu}\nTheo \\cite{a}, bệnh \\emph{nhẹ}.\n$I_x = \\frac{a}{b}$ là chỉ số.\n\\textbf{Lưu ý}\nĐường dẫn C:\\du\\lieu.", "ll.l."),
    ("\\begin{itemize}\n\\item Ho khan\n\\item Sốt\n\\end{itemize}\n$$\nx = \\sum_i y_i\n$$\nCâu thường.", "llll...."),
    ("Tỉ lệ 79\\% \\textsuperscript{a} ở người lớn.\nLiều \\SI{5}{\\milli\\gram}.\nTỉ lệ 50% ở trẻ em\\footnote{Theo A.}\nSao \\* và gạch \\_ thoát.", "lll."),
    ("\\begin{tabular}{ll}\nho & nặng \\\\\nsốt & nhẹ \\\\\n\\end{tabular}\n\\subsection*{Biểu hiện}\nCâu thường.", "lllll."),
    ("Thẻ `<br>` và lệnh `\\item` giữ nguyên.\n```\n<div>x</div>\n\\textbf{y} {{z}} [[t]]\n```\nGiá từ $5 đến $7.", "......"),
    ("<p>Theo \\cite{b} và [[trang]].</p>\n{{nguồn}}<br>\n&nbsp;\\emph{x}\n'''y''' &amp; z\n\\item <b>t</b>", ("hwl", "hw", "hl", "hw", "hl")),
    ("> Trích dẫn dài của một người bệnh.\n1. Đầu tiên\n* [Trang chủ](/) | [Tin](https://vidu.example/t)\n---\n[Xem thêm][1]\n## Mục", "......"),
)
_LETTER = {"h": "html", "w": "wiki", "l": "latex"}


def trained() -> dict[str, Tree]:
    """One tree a kind, trained on the labelled table."""
    rows, labels = [], []
    for text, marks in LABELLED:
        for no, features in blocks(text):
            rows.append(features)
            labels.append({_LETTER[m] for m in marks[no - 1] if m != "."})
    x = np.array(rows)
    return {k: Tree().fit(x, np.array([k in y for y in labels])) for k in KINDS}


def kinds_by_line(text: str, trees: dict[str, Tree]) -> list[tuple[int, str]]:
    return [(no, k) for no, features in blocks(text) for k in KINDS if trees[k].predict(features) > 0.5]


def markup_lines(texts: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    """(table_name, record_key, line_no, markup), distinct: one row a line and kind of foreign markup in it.

    Fenced and inline code and formulas between dollar signs are not looked at; lines count from 1 at ``\\n``. Null and
    empty texts have no lines, an unclosed fence or comment reaches the end of its text, repeated rows count once.
    """
    trees = trained()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, no, kind) for k, body in batch.itertuples(index=False, name=None) for no, kind in kinds_by_line(body, trees)]
            yield pd.DataFrame(rows, columns=["record_key", "line_no", "markup"])

    rows = texts.filter(F.length(text) > 0).select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))
    found = rows.mapInPandas(read, "record_key string, line_no int, markup string")
    return found.select(F.lit(table_name).alias("table_name"), "record_key", "line_no", "markup").distinct()


_INLINE = (
    (re.compile(r"<!--.*?(?:-->|$)", re.DOTALL), ""),
    (re.compile(r"<(script|style)\b.*?</\1\s*>", re.DOTALL | re.IGNORECASE), ""),
    (re.compile(r"<br\s*/?>", re.IGNORECASE), "\n"),
    (re.compile(r"<(/?)(?:b|strong)(?:\s[^<>]*)?>", re.IGNORECASE), "**"),
    (re.compile(r"<(/?)(?:i|em)(?:\s[^<>]*)?>", re.IGNORECASE), "*"),
    (re.compile(r"<(/?)code(?:\s[^<>]*)?>", re.IGNORECASE), "`"),
    (re.compile(r"<a\s[^<>]*?href=[\"']([^\"']*)[\"'][^<>]*>(.*?)</a>", re.IGNORECASE | re.DOTALL), r"[\2](\1)"),
    (re.compile(r"<li(?:\s[^<>]*)?>\s*", re.IGNORECASE), "\n- "),
    (re.compile(r"</t[dh]>\s*<t[dh](?:\s[^<>]*)?>", re.IGNORECASE), " | "),
    (re.compile(r"<tr(?:\s[^<>]*)?>\s*<t[dh](?:\s[^<>]*)?>", re.IGNORECASE), "\n| "),
    (re.compile(r"</t[dh]>\s*</tr>", re.IGNORECASE), " |"),
    (_TAG, ""),
    (re.compile(r"\[\[(?:Tập tin|File|Image|Hình):[^\[\]]*?\|?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"'''([^'\n]+)'''"), r"**\1**"),
    (re.compile(r"''([^'\n]+)''"), r"*\1*"),
    (re.compile(r"(?<!\[)\[((?:https?:)?//[^\s\]]+) ([^\]]*)\](?![(\[])"), r"[\2](\1)"),
    (re.compile(r"\\(?:textbf|strong)\{([^{}]*)\}"), r"**\1**"),
    (re.compile(r"\\(?:emph|textit)\{([^{}]*)\}"), r"*\1*"),
    (re.compile(r"\\SI\{([^{}]*)\}\{(?:\\\w+|[^{}])*\}"), r"\1"),
    (re.compile(r"~?\\(?:cite|label|ref|footnote)\{[^{}]*\}"), ""),
    (re.compile(r"\\[A-Za-z]+\*?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\([%&#_$])"), r"\1"),
)


def _clean_line(line: str) -> str:
    line = html.unescape(line) if _ESCAPED.search(line) else line
    if m := re.match(r"\s*<h([1-6])[^<>]*>(.*?)</h\1>\s*$", line, re.IGNORECASE):
        line = "#" * int(m.group(1)) + " " + m.group(2)
    if m := re.match(r"\s*(={2,6})\s*(.*?)\s*\1\s*$", line):
        line = "#" * len(m.group(1)) + " " + m.group(2)
    if m := re.match(r"\s*\\(sub)*section\*?\{(.*)\}\s*$", line):
        line = "#" * (2 + line.count("sub")) + " " + m.group(2)
    line = re.sub(r"^\s*\\item\s*", "- ", line)
    for pattern, to in _INLINE:
        line = pattern.sub(to, line)
    return html.unescape(line).replace("\xa0", " ")


#: LaTeX environments by what they hold.
_FORMULAS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "flalign", "alignat")
_LISTINGS = ("verbatim", "lstlisting", "minted")
_TABLES = ("tabular", "tabularx", "array", "longtable")
_BEGIN = re.compile(r"\\begin\s*\{([A-Za-z]+)\*?\}")
_SPANS = (("<!--", "-->"), ("<script", "</script"), ("<style", "</style"))


class _Cleaner:
    """Clean Markdown of one text. A block that starts in one line and ends in another is a state; the rest goes line by line."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.until = ""  # what ends a comment, script or style that is left out
        self.braces = 0  # open wiki templates
        self.environment = ""  # formula, listing or table environment of LaTeX
        self.columns = 0  # of the LaTeX table that is open, or -1 before its first row
        self.pre = self.table = False

    def opens(self) -> bool:
        return bool(self.until or self.braces or self.environment or self.pre or self.table)

    def line(self, line: str) -> None:
        if self.until:
            at = line.lower().find(self.until)
            if at < 0:
                return
            line = line[at + len(self.until) :]
            line, self.until = line[line.find(">") + 1 :] if self.until.startswith("</") else line, ""
            if not line.strip():
                return
        if self.pre:
            at = line.lower().find("</pre>")
            self.out += [html.unescape(_TAG.sub("", line if at < 0 else line[:at]))] * (at != 0)
            if at >= 0:
                self.out.append("```")
                self.pre = False
                if line[at + 6 :].strip():
                    self.line(line[at + 6 :])
            return
        if self.environment:
            return self._inside(line)
        if self.braces or ("{{" in line and line.count("{{") > line.count("}}")):
            return self._template(line)
        low = line.lower()
        for start, end in _SPANS:
            at = low.rfind(start)
            if at >= 0 and end not in low[at:] and not (start == "<!--" and "`" in line[:at]):
                self.until = end
                if line[:at].strip():
                    self._plain(line[:at])
                return
        at = low.find("<pre")
        if at >= 0 and (found := re.match(r"<pre(?:\s[^<>]*)?>", low[at:])):
            if line[:at].strip():
                self._plain(line[:at])
            self.out.append("```")
            self.pre = True
            rest = line[at + found.end() :]
            if rest.strip():
                self.line(rest)
            return
        found = _BEGIN.search(line)
        if found and found.group(1) in (*_FORMULAS, *_LISTINGS, *_TABLES):
            if line[: found.start()].strip():
                self._plain(line[: found.start()])
            self.environment, self.columns = found.group(1), -1
            rest = line[found.end() :]
            if self.environment in _TABLES:
                rest = re.sub(r"^(?:\s*\[[^\]]*\])?(?:\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})*", "", rest)
            else:
                self.out.append("$$" if self.environment in _FORMULAS else "```")
            if rest.strip():
                self._inside(rest)
            return
        self._wiki_table(line) or self._plain(line)

    def _template(self, line: str) -> None:
        """Leave out a wiki template of several lines; what stands before and after it on its lines stays."""
        kept = []
        for piece in re.split(r"(\{\{|\}\})", line):
            self.braces += (piece == "{{") - (piece == "}}" and self.braces > 0)
            if not self.braces and piece != "}}":
                kept.append(piece)
        if "".join(kept).strip():
            self._plain("".join(kept))

    def _inside(self, line: str) -> None:
        found = re.search(r"\\end\s*\{" + self.environment + r"\*?\}", line)
        text = line[: found.start()] if found else line
        if self.environment in _TABLES:
            for row in re.split(r"\\\\(?:\[[^\]]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^{}]*\})", "", text)):
                if row.strip():
                    cells = [_clean_math(c.strip()).strip() for c in re.split(r"(?<!\\)&", row)]
                    self.out.append("| " + " | ".join(cells) + " |")
                    if self.columns < 0:
                        self.columns = len(cells)
                        self.out.append("|" + "---|" * len(cells))
        elif text.strip():
            self.out.append(text)
        if found:
            if self.environment not in _TABLES:
                self.out.append("$$" if self.environment in _FORMULAS else "```")
            self.environment = ""
            if line[found.end() :].strip():
                self.line(line[found.end() :])

    def _wiki_table(self, line: str) -> bool:
        start = line.strip()
        if start.startswith("{|") or (self.table and start.startswith("|}")):
            self.table = start.startswith("{|")
            return True
        if not self.table:
            return False
        if not start.startswith("|-") and start:
            cells = [c.strip() for c in re.split(r"\|\||!!", start.lstrip("|!"))]
            self.out.append("| " + " | ".join(_clean_math(c) if c else "" for c in cells) + " |")
            if start.startswith("!"):
                self.out.append("|" + "---|" * len(cells))
        return True

    def _plain(self, line: str) -> None:
        if re.match(r"\s*\\(?:begin|end)\s*\{[A-Za-z*]+\}\s*(?:\[[^\]]*\])?\s*$", line) or re.match(r"\s*</?(?:ul|ol|table|tbody|thead|div)(?:\s[^<>]*)?>\s*$", line, re.IGNORECASE):
            return
        at, pieces = 0, []
        for m in _CODE.finditer(line):  # inline code stays as it is
            pieces += [_clean_math(line[at : m.start()]) if line[at : m.start()] else "", m.group()]
            at = m.end()
        rest = line[at:]
        done = "".join(pieces) + (_clean_math(rest) if rest else "")
        if done.strip():
            self.out += [x for x in done.split("\n") if x.strip()]


def clean_markup(text: str, trees: dict[str, Tree] | None = None) -> str:
    """Clean Markdown of a text: tags, references, wiki and LaTeX syntax become Markdown or vanish; headings, lists, tables stay.

    Only lines that the trees find markup in are changed, and those inside a block that such a line opens: comments,
    scripts and wiki templates vanish to their end, ``pre`` and listings become fenced code, formula environments ``$$``
    lines, wiki and LaTeX tables Markdown tables. Code and formulas are kept as they are. A block that never ends reaches
    the text's end. Blank lines are at most one in a row.
    """
    trees = trees or trained()
    lines, cleaner = text.split("\n"), _Cleaner()
    dirty = {no for no, _ in kinds_by_line(text, trees)}
    for no, (line, seen) in enumerate(zip(lines, visible(lines)), 1):
        if cleaner.opens() or (no in dirty and seen is not None):
            cleaner.line(line)
        else:
            cleaner.out.append(line)
    if cleaner.pre or (cleaner.environment and cleaner.environment not in _TABLES):
        cleaner.out.append("$$" if cleaner.environment in _FORMULAS else "```")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(cleaner.out))


def _clean_math(text: str) -> str:
    at, pieces = 0, []
    for m in _MATH.finditer(text):
        pieces += [_clean_line(text[at : m.start()]) if text[at : m.start()] else "", m.group()]
        at = m.end()
    return "".join(pieces) + (_clean_line(text[at:]) if text[at:] else "")


def clean_texts(texts: DataFrame, text: str) -> DataFrame:
    """The table with ``text`` as clean Markdown; null stays null, and all other columns and rows are kept."""
    trees = trained()
    clean = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else clean_markup(t, trees)), "string")
    return texts.withColumn(text, clean(F.col(text)))
