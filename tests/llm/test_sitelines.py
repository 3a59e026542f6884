import re

from phloem.llm.sitelines import repeated_blocks, site_lines, without_site_lines


def _plain(docs, least):
    seen, at = {}, []
    for aid, source, body in docs:
        if aid is None or source is None or body is None:
            continue
        for no, line in enumerate(body.split("\n"), 1):
            key = re.sub("[0-9]+", "0", " ".join(line.split()).lower())
            if key and not key.startswith("#") and re.search(r"[^\W\d_]", key):
                seen.setdefault((source, key), set()).add(aid)
                at.append((aid, no, (source, key)))
    return {(a, n) for a, n, k in at if len(seen[k]) >= least}


def _docs():
    foot = "Đăng ký\nLiên  hệ 0{n}\n\n© 20{n} Site"
    docs = [(f"a{i}", "s1", f"# T{i}\nriêng {chr(97 + i)}\n## Chung\n" + foot.replace("{n}", str(i)) + "\n***\n2024") for i in range(7)]
    docs += [(f"b{i}", "s2", f"đăng ký\nkhác {chr(97 + i)}\nliên hệ 3") for i in range(4)] + [docs[0], docs[0]]
    docs += [("c1", "s1", "ĐĂNG KÝ\t\nmới"), ("n1", None, "Đăng ký"), (None, "s1", "Đăng ký"), ("n2", "s1", None), ("n3", "s1", ""), ("b0", "s2", "đăng ký"), ("long", "s3", "dòng lặp\n" * 20_000)]
    return docs + [(f"m{i}", "s4", "\n".join(f"câu {chr(97 + k)}" for k in range(20))) for i in range(6)]


def test_against_plain_counts(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, 1) for d in docs], "article_id string, source string, body string, line_no int")
    got = {tuple(r) for r in site_lines(df, "article_id").collect()}
    assert got == _plain(docs, 5)
    cleaned = without_site_lines(df, "article_id")
    assert cleaned.count() == len(docs) and cleaned.columns == df.columns
    assert {r.body for r in cleaned.filter("source = 's4'").collect()} == {""}
    assert site_lines(df.limit(0), "article_id").count() == 0


def test_versions_of_one_id_lose_their_own_lines_only(spark):
    docs = [(f"a{i}", "s1", f"riêng {chr(97 + i)}\nđăng ký") for i in range(6)] + [("a0", "s1", "đăng ký\nnội dung mới"), ("a0", "s2", "mở đầu\nđăng ký")]
    df = spark.createDataFrame(docs, "article_id string, source string, body string")
    got = sorted(tuple(r) for r in without_site_lines(df, "article_id").collect())
    assert got == sorted([(f"a{i}", "s1", f"riêng {chr(97 + i)}") for i in range(6)] + [("a0", "s1", "nội dung mới"), ("a0", "s2", "mở đầu\nđăng ký")])


def test_blocks_of_several_lines(spark):
    docs = [(f"m{i}", "s", "\n".join(["riêng " + chr(97 + i), *(f"câu {chr(97 + k)}" for k in range(20)), "# hết"])) for i in range(6)]
    docs += [(f"p{i}", "s", "câu b\n\ncâu c\nkhác " + chr(97 + i)) for i in range(3)] + [(f"t{i}", "t", "một\nhai " + chr(97 + i)) for i in range(6)]
    df = spark.createDataFrame(docs, "article_id string, source string, body string")
    got = {tuple(r) for r in repeated_blocks(df, "article_id").collect()}
    assert {r for r in got if r[0].startswith("m")} == {(f"m{i}", 2, 20) for i in range(6)}
    assert {r[:3] for r in got if r[0].startswith("p")} == {(f"p{i}", 1, 2) for i in range(3)}
    assert not any(r[0].startswith("t") for r in got)
    assert repeated_blocks(df.limit(0), "article_id").count() == 0
