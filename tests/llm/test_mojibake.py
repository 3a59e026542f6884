from pyspark.sql import functions as F

from phloem.llm.charlm import _ids, ngram_counts, np, word_table
from phloem.llm.mojibake import _TCVN_MEANT, _TCVN_SEEN, CODE_PAGES, FOLDS, CleanReader, Repairer, _spoilt, fitted, from_cp1258, from_tcvn, from_utf8, from_vni, legacy, looks_clean, repairs, split, undone, validation

TEXT = "Người bệnh cần nghỉ ngơi đều đặn, uống đủ nước và tái khám đúng hẹn. Thuốc được dùng mỗi ngày sau bữa ăn."
MORE = ("Bác sĩ chỉ định xét nghiệm máu thường quy để phân biệt viêm phổi với hen.", "Nhiệt độ phòng nên giữ quanh mức dễ chịu để hạn chế đổ mồ hôi đêm.", "A naïve reading of the biopsy may confuse both; it’s rare.", "Le traitement débute par une dose réduite, puis il est réévalué.")


def test_chains_undo_single_byte_codes():
    assert from_tcvn("Kh«ng ng\xadêi ®Çu") == "Không người đầu"
    assert from_vni("daøy laønh ñöôøng roái") == "dày lành đường rối"
    assert __import__("unicodedata").normalize("NFC", from_cp1258("siÞ ðiònh")) == "sĩ định"
    garbled = TEXT.encode().decode("cp1252", "replace")
    assert "�" in garbled or from_utf8("cp1252")(garbled) == TEXT


def test_every_pair_of_chains_is_undone():
    firsts = {p: from_utf8(p) for p in CODE_PAGES}
    for a in CODE_PAGES:
        for b in CODE_PAGES:
            try:
                once = "được".encode().decode(a)
                twice = once.encode().decode(b)
            except UnicodeDecodeError:
                continue
            assert dict(undone(twice, firsts, firsts | legacy()))[f"{a}<{b}"] == "được"
            assert dict(undone(once, firsts, firsts | legacy()))[a] == "được"
    seen = "Kh«ng".encode().decode("latin-1")
    assert dict(undone(seen, firsts, legacy()))["tcvn<latin-1"] == "Không"


def test_found_and_restored(spark):
    clean = [(i, f"{TEXT} {MORE[i % 4]} {MORE[(i + 1) % 4]} số {i}", "vi") for i in range(300)]
    place = "Không".encode().decode("latin-1")
    damaged = [(1000, TEXT.encode().decode("latin-1"), "vi"), (1001, f"Câu đầu. {place} tự ý dùng thuốc.", "vi"), (1002, TEXT.encode().decode("mac_roman"), None), (1003, "Bác s� chỉ định", "vi"), (1004, "th?c qu?n c?a ng??i b?nh", "vi")]
    fine = [(2000, __import__("unicodedata").normalize("NFD", TEXT), "vi"), (2001, "", "vi"), (2002, None, "vi"), (2003, "Thuốc nào? Ai dùng?", "vi"), (2004, "x" * 300_000, "vi")]
    df = spark.createDataFrame([(a, b, c, "k") for a, b, c in clean + damaged + fine], "doc_id int, text string, restored string, id string")
    got = {r.doc_id: r for r in repairs(df, "doc_id").collect()}
    assert set(got) == {1000, 1001, 1002, 1003, 1004}
    assert got[1000].restored == TEXT and got[1001].restored == "Câu đầu. Không tự ý dùng thuốc." and got[1002].restored == TEXT
    assert got[1003].n_lost == 1 and got[1003].restored == "Bác s� chỉ định"


def test_empty(spark):
    assert repairs(spark.createDataFrame([], "doc_id int, text string"), "doc_id").count() == 0


def test_no_record_looks_clean(spark):
    assert repairs(spark.createDataFrame([(1, "Bác s� chỉ định"), (2, TEXT.encode().decode("latin-1"))], "doc_id int, text string"), "doc_id").filter("doc_id = 1").count() == 1


def test_margin_is_validated(spark):
    df = spark.createDataFrame([(i, f"{TEXT} {MORE[i % 4]} số {i}") for i in range(600)], "doc_id int, text string")
    row = validation(df).collect()[0]
    assert row.margin > 0 and row.recall >= 0.9 and row.false_share == 0.0


def test_model_and_margin_come_from_every_record(spark):
    seen = TEXT.translate(str.maketrans(_TCVN_MEANT, _TCVN_SEEN))  # looks clean, yet a chain gains on it
    texts = [f"{TEXT} {MORE[i % 4]} {chr(0x4E00 + i)} số {i}" for i in range(300)] + [f"{seen} {i}" for i in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, TEXT.encode().decode("latin-1"), None, " "])], "doc_id int, text string")
    counts, (margin, recall, false) = fitted(df, "text")
    assert all(looks_clean(t) for t in texts) and (counts[_ids(np.arange(0x4E00, 0x4E00 + 300))[0]] >= 1).all()
    marked = df.filter("length(trim(text)) > 0").select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("mark"))
    clean, garbled = [], []
    for fold in range(FOLDS):
        others = Repairer(ngram_counts(word_table(marked.filter(F.col("mark") % FOLDS != fold), CleanReader)), margin)
        for r in marked.filter(F.col("mark") % FOLDS == fold).collect():
            if looks_clean(r.text):
                clean.append(bool(others.runs(r.text)))
                words = split(r.text)
                at, made = _spoilt(words, r.mark // FOLDS)
                garbled.append(bool(others.runs(" ".join([*words[:at], *made, *words[at + len(made) :]]))))
    assert len(clean) == 303 and sum(clean) == 3
    assert false == 3 / 303 and recall == sum(garbled) / 303
