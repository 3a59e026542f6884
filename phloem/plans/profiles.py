"""Keyword profiles of entities and relations, and the texts that are embedded, as column expressions without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.functions import text as t
from phloem.operators import extract

# Broad keys of each entity type.
TYPE_KEYS = {
    "BENH_LY": ("bệnh và hội chứng",),
    "BIEU_HIEN_LAM_SANG": ("triệu chứng", "biểu hiện lâm sàng"),
    "YEU_TO_BENH_SINH": ("nguyên nhân", "cơ chế bệnh sinh", "yếu tố nguy cơ nội tại"),
    "YEU_TO_NGOAI_SINH": ("yếu tố môi trường", "yếu tố kích hoạt bên ngoài"),
    "PHUONG_PHAP_CHAN_DOAN": ("chẩn đoán", "xét nghiệm", "phương pháp chẩn đoán"),
    "CAN_THIEP_Y_TE": ("điều trị", "can thiệp y tế", "chăm sóc"),
    "THUOC_VA_HOAT_CHAT": ("thuốc", "hoạt chất", "điều trị bằng thuốc"),
    "VI_TRI_GIAI_PHAU": ("vị trí cơ thể", "vùng tổn thương", "giải phẫu"),
    "DOI_TUONG": ("nhóm bệnh nhân", "đối tượng nguy cơ"),
}
# Broad keys of each relation type.
RELATION_KEYS = {
    "LA_DANG_CUA": ("phân loại bệnh", "dạng bệnh", "thể bệnh"),
    "DONG_NGHIA_VOI": ("tên gọi khác", "đồng nghĩa", "thuật ngữ tương đương"),
    "CHAN_DOAN_PHAN_BIET_VOI": ("chẩn đoán phân biệt", "dễ nhầm với", "phân biệt bệnh"),
    "CO_BIEU_HIEN": ("triệu chứng", "biểu hiện lâm sàng", "gợi ý bệnh từ triệu chứng"),
    "LIEN_QUAN_YEU_TO": ("yếu tố liên quan", "yếu tố nguy cơ", "yếu tố kích hoạt"),
    "GAY_BIEN_CHUNG": ("biến chứng", "dẫn đến", "nguy cơ phát sinh bệnh"),
    "ANH_HUONG_DEN": ("vị trí ảnh hưởng", "vùng tổn thương", "đối tượng ảnh hưởng"),
    "CHAN_DOAN_BANG": ("chẩn đoán", "xét nghiệm", "phương pháp chẩn đoán"),
    "DIEU_TRI_BANG": ("điều trị", "kiểm soát bệnh", "can thiệp điều trị"),
    "PHONG_NGUA_BANG": ("phòng ngừa", "phòng tránh", "giảm nguy cơ"),
    "CAN_TRANH": ("cần tránh", "kiêng", "tránh yếu tố kích thích"),
    "CHONG_CHI_DINH": ("chống chỉ định", "không nên dùng", "cảnh báo điều trị"),
    "TUONG_TAC_VOI": ("tương tác", "tương tác thuốc", "tương tác hoạt chất"),
}
# What a relation type is called in a keyword.
RELATION_NAMES = {
    "LA_DANG_CUA": "phân loại", "DONG_NGHIA_VOI": "tên gọi khác", "CHAN_DOAN_PHAN_BIET_VOI": "chẩn đoán phân biệt", "CO_BIEU_HIEN": "triệu chứng",
    "LIEN_QUAN_YEU_TO": "yếu tố liên quan", "GAY_BIEN_CHUNG": "biến chứng", "ANH_HUONG_DEN": "ảnh hưởng", "CHAN_DOAN_BANG": "chẩn đoán", "DIEU_TRI_BANG": "điều trị",
    "PHONG_NGUA_BANG": "phòng ngừa", "CAN_TRANH": "cần tránh", "CHONG_CHI_DINH": "chống chỉ định", "TUONG_TAC_VOI": "tương tác",
}
# Folded cues in a text, and the themes that they hint at.
HINT_CUES = (
    (("kho khe", "kho tho", "ho ", "tuc nguc", "hen", "phoi", "phe quan"), ("triệu chứng hô hấp", "bệnh hô hấp")),
    (("ngua", "ban do", "da kho", "bong vay", "mun nuoc", "da dau", "khuu tay", "cham", "vay nen"), ("triệu chứng da", "bệnh da liễu")),
    (("bui", "phan hoa", "long thu", "mat bui", "di nguyen", "di ung", "hoa chat"), ("yếu tố dị ứng",)),
    (("virus", "vi khuan", "nhiem trung", "nam"), ("nhiễm trùng",)),
    (("tre so sinh", "tre em", "nguoi lon", "phu nu mang thai"), ("đối tượng nguy cơ",)),
)
# Folded keys that say nothing.
GENERIC = ("benh ly", "trieu chung benh", "van de", "tinh trang suc khoe", "trieu chung chung")

_EDGE = r"[ \-–—:;,.()\[\]{}\n\t]+"
_EDGE_SIGNS = " -–—:;,.()[]{}\n\t"
_NONE = "array<string>"


def clean_text(c: Column) -> Column:
    return F.regexp_replace(t.collapse(F.coalesce(c, F.lit(""))), rf"^{_EDGE}|{_EDGE}$", "")


def key(c: Column) -> Column:
    """How keys are compared: lower case without accents, blanks collapsed."""
    return t.collapse(t.strip_marks(c))


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def _keyed(cleaned: Column) -> Column:
    """A cleaned text as a candidate for a key: itself, its key, and whether it says something in at most eight words."""
    blanks = F.size(F.split(cleaned, " "))  # cleaned texts have single blanks and none outside
    return t.let(t.unmarked(cleaned), lambda k: F.struct(cleaned.alias("v"), k.alias("k"), ((cleaned != "") & (blanks <= 8) & (k != "") & ~k.isin(*GENERIC)).alias("good")))


def candidates(values: Column) -> Column:
    """Texts of an array as candidates for keys; each is cleaned once."""
    return F.transform(values, lambda v: t.let(F.btrim(t.spaced(F.coalesce(v, F.lit(""))), F.lit(_EDGE_SIGNS)), _keyed))


def _fixed(values: tuple[str, ...]) -> Column:
    """Fixed texts as candidates: without functions over arrays, so that the planner computes them and rows do not."""
    each = [(clean_text(F.lit(x)), key(clean_text(F.lit(x)))) for x in values]
    return F.array(*[F.struct(v.alias("v"), k.alias("k"), ((v != "") & (F.size(F.split(v, " ")) <= 8) & (k != "") & ~k.isin(*GENERIC)).alias("good")) for v, k in each])


def clean_keys(found: Column, limit: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Values of candidates that say something, the first of each key, at most ``limit`` that ``keep`` allows by key."""
    first = lambda good: t.let(F.transform(good, lambda x: x["k"]), lambda keys: F.filter(good, lambda x, i: F.array_position(keys, x["k"]) == i + 1))
    allowed = F.filter(found, lambda x: x["good"] & (keep(x["k"]) if keep else F.lit(True)))
    return F.transform(F.slice(t.let(allowed, first), 1, limit), lambda x: x["v"])


def hints(text: Column) -> Column:
    """Themes that a text hints at by its cues, as candidates; the text is folded once."""
    themed = lambda said: F.flatten(F.array(*[F.when(t.holds_any(said, cues), _fixed(themes)).otherwise(F.slice(_fixed(themes), 1, 0)) for cues, themes in HINT_CUES]))
    return t.let(t.unmarked(text), themed)


def _of_type(kind: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """Fixed keys of a type, or its name, as candidates."""
    out = candidates(F.array(F.lower(F.regexp_replace(F.coalesce(kind, F.lit("")), "_", " "))))
    for name, keys in known.items():
        out = F.when(kind == name, _fixed(keys)).otherwise(out)
    return out


def _other_keys(found: Column, limit: int) -> Column:
    """Keys of candidates that are no local keys and do not end in one."""
    other = lambda own: clean_keys(found, limit, lambda k: ~F.exists(own, lambda x: (k == x) | k.endswith(F.concat(F.lit(" "), x))))
    return t.let(F.transform("local_keys", key), other)


def entity_profiles(entities: DataFrame, evidence: str | None = None, local_limit: int = 6, global_limit: int = 5) -> DataFrame:
    """``entities`` with local_keys, global_keys and profile_text.

    Local keys are the name and surface forms that the entity's own texts hold; global keys are broad ones of its type and
    the themes that description and evidence (an array column) hint at, other than local keys or phrases that end in one.
    """
    forms = F.coalesce("surface_forms", F.array().cast(_NONE))
    said = F.coalesce(F.col(evidence), F.array().cast(_NONE)) if evidence else F.array().cast(_NONE)
    name, description = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    support = key(F.concat_ws("\n", name, description, F.array_join(forms, "\n"), F.array_join(said, "\n")))
    local = t.let(support, lambda own: clean_keys(candidates(F.concat(F.array(name), forms)), local_limit, lambda k: own.contains(k)))
    broad = F.concat(_of_type(F.col("entity_type"), TYPE_KEYS), hints(F.concat_ws(" ", description, F.array_join(said, " "))))
    both = entities.withColumn("local_keys", local).withColumn("global_keys", _other_keys(broad, global_limit))
    label = lambda head, body: t.let(body, lambda x: F.when(x != "", F.concat(F.lit(head), x)))
    lines = (
        F.concat(F.lit("Tên thực thể: "), clean_text(name)), F.concat(F.lit("Loại thực thể: "), F.coalesce("entity_type", F.lit(""))), label("Mô tả: ", clean_text(description)),
        label("Local keys: ", F.array_join("local_keys", "; ")), label("Global keys: ", F.array_join("global_keys", "; ")),
    )
    return both.withColumn("profile_text", F.concat_ws("\n", *lines))


def proposed_keys(profiles: DataFrame, local: str, global_: str, local_limit: int = 6, global_limit: int = 5) -> DataFrame:
    """Profiles with keys that a model proposed: local ones are added if the profile's text supports them, global ones replace the broad ones unless none is left."""
    none = F.array().cast(_NONE)
    added = t.let(key(F.col("profile_text")), lambda own: clean_keys(candidates(F.concat("local_keys", F.coalesce(F.col(local), none))), local_limit, lambda k: own.contains(k)))
    fresh = _other_keys(candidates(F.coalesce(F.col(global_), none)), global_limit)
    return profiles.withColumn("local_keys", added).withColumn("global_keys", t.let(fresh, lambda x: F.when(F.size(x) > 0, x).otherwise(F.col("global_keys"))))


def relation_keywords(limit: int = 8) -> Column:
    """Keywords of a relation with its ends' names: both names, the type's keys, and the themes that its texts hint at."""
    said = F.concat_ws(" ", "subject_name", "object_name", "description", "evidence_text")
    names = F.array(F.coalesce("subject_name", F.lit("")), F.coalesce("object_name", F.lit("")))
    return clean_keys(F.concat(candidates(names), _of_type(F.col("relation_type"), RELATION_KEYS), hints(said)), limit)


def validated_keywords(items: Column, limit: int = 5) -> Column:
    """Keywords of an extraction: cut to 80 characters, at most eight words, none that names no entity, the first of each folded form."""
    cleaned = F.transform(F.coalesce(items, F.array().cast(_NONE)), lambda x: t.short_text(x, 80))
    good = F.filter(cleaned, lambda x: (x != "") & (t.fold(x) != "") & (words(x) <= 8) & ~extract.blocked(x))
    first = lambda own: t.let(F.transform(own, t.fold), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))
    return F.slice(t.let(good, first), 1, limit)


def fallback_keywords(subject: Column, kind: Column, object_: Column) -> Column:
    """Keywords for a relation that an extraction gives none: its ends and what its type is called."""
    name = F.lower(kind)
    for k, said in RELATION_NAMES.items():
        name = F.when(kind == k, said).otherwise(name)
    return validated_keywords(F.array(subject, object_, name), 10)


def _lines(*parts: tuple[str, Column]) -> Column:
    line = lambda head, v: t.let(v, lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x)))
    return F.concat_ws("\n", *[line(head, v) for head, v in parts])


def chunk_text() -> Column:
    """What of a chunk is embedded: its text in context, or its text."""
    return F.coalesce(F.nullif(F.col("contextualized_text"), F.lit("")), F.col("text"))


def entity_text() -> Column:
    """What of an entity with its profile is embedded: the profile, and up to eight surface forms and aliases."""
    first = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast(_NONE)), 1, 8), "; ")
    return _lines(("", F.col("profile_text")), ("Cách gọi trong văn bản: ", first(F.col("surface_forms"))), ("Aliases metadata: ", first(F.col("aliases"))))


def relation_text() -> Column:
    """What of a relation with its ends' names is embedded."""
    return _lines(
        ("Quan hệ: ", F.col("relation_type")), ("Subject: ", F.col("subject_name")), ("Object: ", F.col("object_name")),
        ("Keywords: ", F.array_join(F.coalesce("keywords", F.array().cast(_NONE)), "; ")), ("Mô tả: ", F.col("description")), ("Bằng chứng: ", F.col("evidence_text")),
    )
