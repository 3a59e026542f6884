"""Keywords, intents and relation types of questions by cue lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.functions import text as t

# Cues in a question, and the high-level keyword each group stands for.
KEYWORD_CUES = (
    (("triệu chứng", "biểu hiện", "dấu hiệu"), "triệu chứng"),
    (("nguyên nhân", "vì sao", "tại sao", "yếu tố"), "nguyên nhân"),
    (("liên quan", "liên quan đến", "liên quan tới", "dị ứng"), "yếu tố liên quan"),
    (("biến chứng", "nguy hiểm"), "biến chứng"),
    (("chẩn đoán", "xét nghiệm", "phân biệt"), "chẩn đoán"),
    (("điều trị", "chữa", "thuốc", "bôi", "uống"), "điều trị"),
    (("phòng ngừa", "phòng tránh"), "phòng ngừa"),
    (("tránh", "kiêng"), "cần tránh"),
    (("loại", "dạng", "thể", "phân loại"), "phân loại"),
    (("tên khác", "còn gọi", "tiếng anh", "english", "aka"), "tên gọi khác"),
)
# Folded cues of each intent, in order of precedence.
INTENT_CUES = (
    ("symptom_diagnosis", ("co the la", "benh gi", "van de gi", "nen nghi", "nen kham", "khong biet", "goi y", "toi bi", "con toi")),
    ("differential", ("phan biet", "de nham", "nham voi")),
    ("complication", ("bien chung", "dan toi", "gay ra", "nguy hiem")),
    ("taxonomy", ("dang", "the", "loai", "phan loai")),
    ("synonym", ("con goi", "ten khac", "dong nghia", "tieng anh", "aka")),
)
# Folded cues and the relation types they ask for, in order.
RELATION_CUES = (
    (("trieu chung", "bieu hien", "dau hieu", "ngua", "kho tho", "kho khe", "ho"), ("CO_BIEU_HIEN", "ANH_HUONG_DEN")),
    (("nguyen nhan", "yeu to", "lien quan", "di ung", "bui", "phan hoa", "long thu", "mat bui"), ("LIEN_QUAN_YEU_TO",)),
    (("bien chung", "dan toi", "gay ra", "nguy hiem"), ("GAY_BIEN_CHUNG",)),
    (("phan biet", "de nham", "nham voi", "chan doan"), ("CHAN_DOAN_PHAN_BIET_VOI", "CHAN_DOAN_BANG")),
    (("dieu tri", "chua", "thuoc", "boi", "uong"), ("DIEU_TRI_BANG",)),
    (("phong ngua", "phong tranh"), ("PHONG_NGUA_BANG",)),
    (("tranh", "kieng"), ("CAN_TRANH",)),
    (("dang", "the", "loai", "phan loai"), ("LA_DANG_CUA",)),
    (("con goi", "ten khac", "dong nghia", "tieng anh", "aka"), ("DONG_NGHIA_VOI",)),
)
# Phrases of a question that are no entity, in the order in which they are taken out, and what parts entities.
ASIDE = (
    ("có", "gồm", "là", "bao gồm", "như thế nào", "gì", "nào", "không"),
    ("liên quan đến", "liên quan tới", "liên quan", "đến", "tới"),
    ("triệu chứng", "biểu hiện", "dấu hiệu", "nguyên nhân", "yếu tố", "biến chứng", "điều trị", "chẩn đoán", "phòng ngừa", "cần tránh", "phân loại"),
)
PARTING = ("và", "hay", "hoặc", "liên quan đến", "liên quan tới")
# Fixed value: the query text for relations of symptom questions.
SYMPTOM_TEXT = "triệu chứng; biểu hiện; yếu tố liên quan; dị ứng"
SYMPTOM_RELATIONS = ("CO_BIEU_HIEN", "LIEN_QUAN_YEU_TO", "ANH_HUONG_DEN", "CHAN_DOAN_PHAN_BIET_VOI")


def high_keywords(question: Column) -> Column:
    """The keyword of each cue group that the question holds; a general one if none."""
    low = F.lower(question)
    found = F.array_compact(F.array(*[F.when(t.contains_any(low, cues), F.lit(word)) for cues, word in KEYWORD_CUES]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("thông tin y khoa")))


def _whole(words: tuple[str, ...]) -> str:
    """A pattern of whole words; letters with and without marks count as letters."""
    return r"(?<![\p{L}\p{M}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{M}\p{N}_])"


def low_keywords(question: Column, limit: int = 6) -> Column:
    """The entity phrases that are left of a question once its asking words are taken out; the question itself if none is."""
    text = F.lower(F.regexp_replace(F.trim(question), r"^[ ?!.。]+|[ ?!.。]+$", ""))
    for words in ASIDE:
        text = F.regexp_replace(text, _whole(words), " ")
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[,;:/]|" + _whole(PARTING))
    trimmed = F.filter(F.transform(parts, F.trim), lambda x: F.length(x).between(2, 80))
    kept = F.array_except(trimmed, high_keywords(question))
    return clean_keywords(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.trim(question))), limit)


def distinct_keywords(words: Column) -> Column:
    """Of the words with the same folded letters the first; one letter or none is no keyword."""
    trimmed = F.transform(words, F.trim)
    keys = F.transform(trimmed, t.fold_alnum)
    return F.filter(trimmed, lambda w, i: (F.length(t.fold_alnum(w)) > 1) & (F.array_position(keys, t.fold_alnum(w)) == i + 1))


def query_text(words: Column) -> Column:
    return F.array_join(words, "; ")


def keyword_union(a: Column, b: Column) -> Column:
    """Both lists in order, each word once."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def understood(questions: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with low, high, low_text, high_text, intent and relation types (null: any), read from the question and its keywords."""
    q = F.trim(text)
    words = questions.withColumns({"low": distinct_keywords(low_keywords(q)), "high": distinct_keywords(high_keywords(q))})
    said = F.concat_ws(" ", q, F.array_join("low", " "), F.array_join("high", " "))
    read = words.withColumns({"intent": intent(said), "types": relation_types(said)})
    low = F.coalesce(F.nullif(query_text(F.col("low")), F.lit("")), q)
    high = F.when(F.col("intent") == "symptom_diagnosis", SYMPTOM_TEXT).otherwise(F.coalesce(F.nullif(query_text(F.col("high")), F.lit("")), q))
    return read.withColumns({"low_text": low, "high_text": high})


def intent(question: Column) -> Column:
    text = t.fold_alnum(question)
    out = F.lit("general_fact")
    for name, cues in reversed(INTENT_CUES):
        out = F.when(t.contains_any(text, cues), name).otherwise(out)
    return out


def relation_types(question: Column) -> Column:
    """Relation types that a question asks for; null if no cue is met."""
    text = t.fold_alnum(question)
    groups = [F.when(t.contains_any(text, cues), F.array(*[F.lit(k) for k in kinds])).otherwise(F.array().cast("array<string>")) for cues, kinds in RELATION_CUES]
    found = F.array_distinct(F.concat(*groups))
    return F.when(intent(question) == "symptom_diagnosis", F.array(*[F.lit(k) for k in SYMPTOM_RELATIONS])).when(F.size(found) > 0, found)


def clean_keywords(words: Column, limit: int = 6, most_words: int = 8) -> Column:
    """Trimmed of punctuation, at most ``most_words`` words, each once without case (the first spelling), at most ``limit``."""
    edge = r"[ \-–—:;,.()\[\]{}\n\t]+"
    plain = F.filter(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, rf"^{edge}|{edge}$", ""), r"\s+", " ")), lambda w: (w != "") & (F.size(F.split(w, " ")) <= most_words))
    lowered = F.transform(plain, F.lower)
    return F.slice(F.filter(plain, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1), 1, limit)
