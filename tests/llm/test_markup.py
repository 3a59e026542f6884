from phloem.llm.markup import LABELLED, clean_markup, clean_texts, kinds_by_line, markup_lines, trained

HELD_OUT = (
    ("Bài <i>mới</i> có <script>alert(1)</script>", {"html"}),
    ("{{Hộp thông tin|tên=x}}", {"wiki"}),
    ("Thuốc [[aspirin]] và &lt;b&gt;", {"wiki", "html"}),
    ("\\textit{nghiêng} theo \\ref{h}", {"latex"}),
    ("Huyết áp <120/80, p < 0,05 & ổn định", set()),
    ("`<b>` và ``[[x]]`` và $\\alpha_1$", set()),
    ("[nhãn](https://a.example/x?a=1&b=2) <https://b.example>", set()),
    ("Giá 5$ đến 10$ \\* không", set()),
    ("| a | b |", set()),
    ("===== Sâu =====", {"wiki"}),
    ("</div>", {"html"}),
    ("&copy; 2024", {"html"}),
)


def test_labelled_table_is_learnt_and_held_out_lines_hold():
    trees = trained()
    names = {"h": "html", "w": "wiki", "l": "latex"}
    for text, marks in LABELLED:
        got = kinds_by_line(text, trees)
        want = {(no, names[m]) for no, ms in enumerate(marks, 1) for m in ms if m != "."}
        assert set(got) == want
    for line, want in HELD_OUT:
        assert {k for _, k in kinds_by_line(line, trees)} == want, line


def test_edge_texts(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "```\n<b>\n", "t"), (4, "<!-- a\nb\n-->", "t"), (4, "<!-- a\nb\n-->", "t"), (5, "x " * 200_000 + "<br>", "t"), (None, "<p>", "t")]
    df = spark.createDataFrame(rows, "id int, body string, table_name string")
    got = {(r.record_key, r.line_no, r.markup) for r in markup_lines(df, "t", "id", "body").collect()}
    assert got == {("4", 1, "html"), ("4", 2, "html"), ("4", 3, "html"), ("5", 1, "html"), (None, 1, "html")}
    assert markup_lines(df, "t", "id", "body").count() == 5
    assert markup_lines(df.limit(0), "t", "id", "body").count() == 0
    assert clean_texts(df, "body").count() == len(rows)


def test_clean_keeps_structure():
    dirty = "# Tên\n\n<p>Một <b>hai</b>&nbsp;ba</p>\n== Mục ==\n{| class=\"w\"\n! A !! B\n|-\n| 1 || 2\n|}\n<ul>\n<li>ho</li>\n</ul>\n\\begin{itemize}\n\\item sốt\n\\end{itemize}\n```\n<b>giữ</b>\n```\n$$\nx_{1}\n$$\nchỉ số $\\frac{a}{b}$ và `\\item`"
    assert clean_markup(dirty) == "# Tên\n\nMột **hai** ba\n## Mục\n| A | B |\n|---|---|\n| 1 | 2 |\n- ho\n- sốt\n```\n<b>giữ</b>\n```\n$$\nx_{1}\n$$\nchỉ số $\\frac{a}{b}$ và `\\item`"
    again = clean_markup(dirty)
    assert clean_markup(again) == again


def test_blocks_over_several_lines_are_cleaned_as_blocks():
    cases = {
        "\\begin{equation}\nx = \\frac{a}{b}\n\\end{equation}": "$$\nx = \\frac{a}{b}\n$$",
        "x \\begin{align*} a &= b \\\\ c \\end{align*} y": "x \n$$\n a &= b \\\\ c \n$$\n y",
        "<!-- mở\nvẫn trong ghi chú\nđóng -->\nsau": "sau",
        "{{Thông tin\n| tên = Viêm\n| nhóm = {{a}}\n}}\nCâu ''nghiêng''": "Câu *nghiêng*",
        "<pre>\na < b\n  c &lt;d&gt;\n</pre>\nx": "```\na < b\n  c <d>\n```\nx",
        "<pre>một</pre> hai": "```\nmột\n```\n hai",
        "<script>\nvar x=1;\n</script>\nrest": "rest",
        "<style>a\nb</style>z <b>k</b>": "z **k**",
        "\\begin{tabular}{ll}\n\\hline\nho & nặng \\\\\nsốt & nhẹ \\\\\n\\end{tabular}": "| ho | nặng |\n|---|---|\n| sốt | nhẹ |",
        "`<!--` và <b>x</b>\nsau": "`<!--` và **x**\nsau",
        "Nguyên nhân\n===\n[1] không & đổi < 5": "Nguyên nhân\n===\n[1] không & đổi < 5",
        "<!-- không đóng\nmất": "",
        "<pre>không đóng\nx": "```\nkhông đóng\nx\n```",
    }
    trees = trained()
    for dirty, clean in cases.items():
        assert clean_markup(dirty, trees) == clean, dirty


def test_the_trees_decide_by_words_too():
    from phloem.llm.markup import FEATURES

    def used(node):
        return set() if len(node) == 1 else {FEATURES[node[0]]} | used(node[2]) | used(node[3])

    trees = trained()
    assert "words" in used(trees["wiki"].node)
    assert {k for _, k in kinds_by_line("Mục\n=======", trees)} == set() and {k for _, k in kinds_by_line("==Mục==", trees)} == {"wiki"}
