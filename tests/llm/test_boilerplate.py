from phloem.llm.boilerplate import boilerplate_lines, frame, label, read_page


def _page(i, host="a"):
    word = "".join(chr(97 + (i * 7 + k * 3) % 26) for k in range(6))
    article = [f"# Bài {word}", "", f"Đoạn văn của bài {word} nói về bệnh, cách chữa và nhiều điều khác nữa cho đủ dài.", "", "## Điều trị", "", f"Chữa {word} bằng thuốc và nghỉ ngơi trong nhiều ngày liền, theo dõi kỹ tại nhà.", "", f"- ý {word}"]
    head = ["Trang dùng cookie", "", "Trang chủ > Mục > Bài " + word, ""]
    foot = ["", "Quảng cáo", "", "## Xem tiếp", f"- [Bài {word}x](https://{host}.example/{word})", "", "Đọc nhiều", f"Tên bài {word}y", "", f"© 20{i:02d} Site"]
    lines = head + article + foot
    want = [n for n, x in enumerate(lines, 1) if x and not (len(head) < n <= len(head) + len(article))]
    return "\n".join(lines), f"Bài {word}", want


def test_template_is_told_from_articles(spark):
    pages = [(i, f"https://h.example/{i}", "h", *_page(i)[:2]) for i in range(12)]
    pages += [(100, "https://h.example/0", "h", *_page(0)[:2]), (0, *pages[0][1:]), (200, None, "lonely", "# Một\n\nchữ", None), (300, None, None, None, None), (301, "u", "h", "", "x"), (302, "https://h.example/z", "h", "dòng " * 50_000, None)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "item_id int, url string, source string, markdown string, title string, line_no int")
    got = {tuple(r) for r in boilerplate_lines(df, "item_id").collect()}
    want = {(i, n) for i in range(12) for n in _page(i)[2]} | {(100, n) for n in _page(0)[2]}
    assert got == want
    assert boilerplate_lines(df.limit(0), "item_id").count() == 0


def test_frames_and_labels():
    assert frame("Trang chủ > Tên bài", "Tên bài") == "Trang chủ > ⟨T⟩"
    assert frame("- [a](https://x/1) 12/3/2024", None) == "- [L](U) 0/0/0"
    assert label("Xem thêm: [L](U)") == "Xem thêm:" and label(">> Tên") == ">>" and label("> trích") is None
    kinds = [x[2] for x in read_page("# T\n```\ncode\n```\n$$\nx\n$$\n| a |\nchữ", "T")]
    assert kinds == [3, 4, 4, 4, 4, 4, 4, 4, 0]


def test_article_lines_that_a_host_repeats_are_kept(spark):
    def page(i):
        lines = _page(i)[0].split("\n")
        at = lines.index("## Điều trị")
        shared = ["Người bệnh nên nghỉ ngơi đầy đủ, uống nhiều nước và tái khám đúng hẹn của bác sĩ.", "", f"- riêng {lines[4][-6:]}", "- uống đủ nước", ""] if i < 5 else []
        label = [f"Lưu ý: người mắc {lines[4][-6:]} không nên tự ý ngừng thuốc khi chưa hỏi bác sĩ điều trị.", ""] if i % 2 else []
        mark = ["Tài trợ", ""] if i % 3 == 0 else []
        return "\n".join(lines[:at] + shared + label + mark + lines[at:])

    pages = [(i, f"https://h.example/{i}", "h", page(i), _page(i)[1]) for i in range(12)]
    df = spark.createDataFrame(pages, "item_id int, url string, source string, markdown string, title string")
    got = {tuple(r) for r in boilerplate_lines(df, "item_id").collect()}
    lines = {(i, no): x for i, _, _, m, _ in pages for no, x in enumerate(m.split("\n"), 1) if x}
    gone = {x for k, x in lines.items() if k in got}
    assert not any(x.startswith(("Người bệnh", "- uống", "- riêng", "Lưu ý")) for x in gone)
    assert {"Tài trợ", "Quảng cáo", "Đọc nhiều", "## Xem tiếp"} <= gone
    assert got == {k for k, x in lines.items() if x == "Tài trợ"} | {(i, n) for i, no in {i: page(i).split("\n").index("Quảng cáo") + 1 for i in range(12)}.items() for n in [1, 3, *range(no, len(page(i).split("\n")) + 1)] if (i, n) in lines}


def test_support_is_the_same_at_every_host_size(spark):
    rare = "Đường dây nóng mùa dịch"
    pages = [(i, f"https://h.example/{i}", "h", _page(i)[0] + (f"\n\n{rare}" if i < 5 else ""), _page(i)[1]) for i in range(600)]
    df = spark.createDataFrame(pages, "item_id int, url string, source string, markdown string, title string")
    want = {(i, len(pages[i][3].split("\n"))) for i in range(5)}
    assert want <= {tuple(r) for r in boilerplate_lines(df, "item_id").collect()}
