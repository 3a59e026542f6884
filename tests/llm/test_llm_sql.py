import pytest

from phloem.llm.queries import QUERIES, SQL
from tests.compare import compare, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    why, _ = compare(spark, duck(sf), sf, QUERIES[name], SQL[name])
    assert not why, why


#: Columns of the queries without SQL, and how many rows they have at least on the smallest tables.
EXPECTED = {
    "p1_found": ("point_id_a point_id_b", 100), "p1_nearest": ("point_id neighbour similarity", 300), "p3_found": ("table_name record_key line_no markup", 20), "p3_clean": ("table_name record_key clean", 140),
    "p4_found": ("field_name entity_id_a entity_id_b", 1), "p4_forms": ("field_name entity_id value form", 400), "p4_classes": ("field_name form value entity_id", 2), "p6_clean": ("article_id source body", 100),
    "p6_blocks": ("article_id line_no n_lines", 1), "p7_found": ("item_id line_no", 100), "p8_packed": ("spec_id container_id doc_id piece first_token tokens", 200), "p8_fill": ("spec_id containers items tokens capacity_tokens least_containers used", 3),
    "p9_mixed": ("doc_id source tokens copies", 1), "p9_shares": ("source target_share max_repeats records available wanted budget n_copies reached reached_share share_of_total capped", 15),
    "p10_found": ("doc_id", 1), "p10_restored": ("doc_id restored n_runs n_lost gain", 1), "p10_validation": ("margin recall false_share", 1),
}


@pytest.fixture(scope="module")
def tables(sf):
    return duck(sf)


def _rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    columns, least = EXPECTED[name]
    assert df.columns == columns.split(), name
    assert len(rows) >= least, (name, len(rows))
    return rows


def test_every_query_is_checked():
    assert set(EXPECTED) == set(QUERIES) - set(SQL)


@pytest.mark.parametrize("name", ["p3_found", "p3_clean", "p4_found", "p4_forms", "p4_classes", "p6_clean", "p6_blocks", "p10_restored", "p10_validation"])
def test_shape(spark, sf, name):
    _rows(spark, sf, name)


def test_p1_pairs_are_among_the_nearest(spark, sf, tables):
    """Recall and precision of the pairs against brute force on the whole table."""
    import numpy as np

    got = {tuple(r) for r in _rows(spark, sf, "p1_found")}
    points = tables.execute("SELECT DISTINCT point_id, vector FROM vector_points WHERE len(vector) = 96").fetchall()
    points = [(i, np.array(v, float)) for i, v in points if None not in v]
    points = [(i, v / np.linalg.norm(v)) for i, v in points if np.isfinite(v).all() and v.any()]
    ids, x = [i for i, _ in points], np.stack([v for _, v in points])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {tuple(sorted((ids[a], ids[b]))) for a in range(len(ids)) for b in top[a] if s[a, b] >= 0.75}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
    each: dict = {}
    for r in _rows(spark, sf, "p1_nearest"):
        each.setdefault(r.point_id, set()).add(r.neighbour)
    assert max(map(len, each.values())) == 5 and all(i not in near for i, near in each.items())


def test_p7_lines_are_lines_of_their_page(spark, sf, tables):
    lines = {(i, n) for i, m in tables.execute("SELECT item_id, markdown FROM article_items WHERE markdown IS NOT NULL").fetchall() for n, x in enumerate(m.split("\n"), 1) if x.strip()}
    got = {tuple(r) for r in _rows(spark, sf, "p7_found")}
    assert got <= lines and len(got) < len(lines)


def test_p8_packs_every_token_once(spark, sf, tables):
    capacity = dict(tables.execute("SELECT spec_id, capacity_tokens FROM pack_specs").fetchall())
    load: dict = {}
    total: dict = {}
    for r in _rows(spark, sf, "p8_packed"):
        load[r.spec_id, r.container_id] = load.get((r.spec_id, r.container_id), 0) + r.tokens
        total[r.spec_id] = total.get(r.spec_id, 0) + r.tokens
    assert all(n <= capacity[s] for (s, _), n in load.items()) and len(set(total.values())) == 1 and set(total) == set(capacity)
    for r in _rows(spark, sf, "p8_fill"):
        assert r.least_containers <= r.containers <= 1.02 * r.least_containers + 1 and r.tokens == total[r.spec_id]


def test_p9_shares_are_those_of_the_mix(spark, sf, tables):
    repeats = dict(tables.execute("SELECT source, max_repeats FROM mix_targets").fetchall())
    reached: dict = {}
    for r in _rows(spark, sf, "p9_mixed"):
        assert 1 <= r.copies <= repeats[r.source]
        reached[r.source] = reached.get(r.source, 0) + r.tokens * r.copies
    for r in _rows(spark, sf, "p9_shares"):
        assert r.reached == reached.get(r.source, 0) and r.budget <= r.wanted


def test_p10_restored_texts_are_of_found_documents(spark, sf):
    found = {r.doc_id for r in _rows(spark, sf, "p10_found")}
    assert found == {r.doc_id for r in _rows(spark, sf, "p10_restored")}
