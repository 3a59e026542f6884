"""The graph's fixed schema: entity types, relation types and which types a relation may join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity types.
ENTITY_TYPES = (
    "BENH_LY", "BIEU_HIEN_LAM_SANG", "YEU_TO_BENH_SINH", "YEU_TO_NGOAI_SINH", "PHUONG_PHAP_CHAN_DOAN",
    "CAN_THIEP_Y_TE", "THUOC_VA_HOAT_CHAT", "VI_TRI_GIAI_PHAU", "DOI_TUONG",
)

# For each relation type, the entity types of its subject and of its object.
RELATION_ENDS = {
    "LA_DANG_CUA": (("BENH_LY",), ("BENH_LY",)),
    "CHAN_DOAN_PHAN_BIET_VOI": (("BENH_LY",), ("BENH_LY",)),
    "CO_BIEU_HIEN": (("BENH_LY",), ("BIEU_HIEN_LAM_SANG",)),
    "LIEN_QUAN_YEU_TO": (("BENH_LY",), ("YEU_TO_BENH_SINH", "YEU_TO_NGOAI_SINH")),
    "GAY_BIEN_CHUNG": (("BENH_LY",), ("BENH_LY",)),
    "ANH_HUONG_DEN": (("BENH_LY", "BIEU_HIEN_LAM_SANG"), ("VI_TRI_GIAI_PHAU", "DOI_TUONG")),
    "CHAN_DOAN_BANG": (("BENH_LY",), ("PHUONG_PHAP_CHAN_DOAN", "BIEU_HIEN_LAM_SANG")),
    "DIEU_TRI_BANG": (("BENH_LY", "BIEU_HIEN_LAM_SANG"), ("CAN_THIEP_Y_TE", "THUOC_VA_HOAT_CHAT")),
    "PHONG_NGUA_BANG": (("BENH_LY",), ("CAN_THIEP_Y_TE", "YEU_TO_NGOAI_SINH")),
    "CAN_TRANH": (("BENH_LY", "DOI_TUONG"), ("YEU_TO_NGOAI_SINH", "THUOC_VA_HOAT_CHAT")),
    "CHONG_CHI_DINH": (("THUOC_VA_HOAT_CHAT", "CAN_THIEP_Y_TE"), ("BENH_LY", "DOI_TUONG")),
    "TUONG_TAC_VOI": (("THUOC_VA_HOAT_CHAT",), ("THUOC_VA_HOAT_CHAT", "YEU_TO_NGOAI_SINH")),
    "DONG_NGHIA_VOI": (ENTITY_TYPES, ENTITY_TYPES),
}


def allowed_ends() -> list[tuple[str, str, str]]:
    """(relation_type, subject_type, object_type), 137 rows, all that the schema allows."""
    return [(r, s, o) for r, (subjects, objects) in RELATION_ENDS.items() for s in subjects for o in objects]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(allowed_ends(), "relation_type string, subject_type string, object_type string")
