import hashlib

from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, rows_of

from halfstar.llm import exact_dedup as exact_dedup_module
from halfstar.llm.exact_dedup import exact_dedup, keep_first

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(WHITE), []).append(r)
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[0], members[0][0], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_hard_cases(hard_docs):
    assert found(exact_dedup(hard_docs)) == brute([tuple(r) for r in hard_docs.collect()])
    stay = keep_first(hard_docs)
    assert stay.columns == hard_docs.columns and stay.count() == exact_dedup(hard_docs).where("kept").count()


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0 and keep_first(no_docs).count() == 0


def test_hot_group(make_docs):
    rows = rows_of([PROSE + " " * (i % 5) if i % 3 == 0 else f"{PROSE} {i}" for i in range(900)])
    assert found(exact_dedup(make_docs(rows))) == brute(rows)


def test_texts_move_once_and_cut_groups_meet(make_docs, spark):
    """One exchange carries texts; a group over a third of all rows is in several runs."""
    rows = rows_of([PROSE + " " * (i % 7) if i % 2 == 0 else f"{i} {PROSE}" for i in range(2000)])
    docs = make_docs(rows).repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut = exact_dedup_module.runs(docs, "doc_id", "text")
        text = cut._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hash" not in text and "Exchange range" not in text
        sizes = [r["_n"] for r in cut.where("_first").collect()]
        assert len(sizes) > 1000 + 4 and max(sizes) < 500 and sum(sizes) == 2000
        assert found(exact_dedup(docs)) == brute(rows)
        stay = keep_first(docs)
        assert sorted(r.doc_id for r in stay.collect()) == sorted(r.doc_id for r in exact_dedup(docs).where("kept").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ids_of_any_type(make_docs, spark):
    rows = rows_of([PROSE, PROSE + " ", "x", " x", "x"])
    docs = make_docs(rows).selectExpr("concat('d', doc_id) as doc_id", "text")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {"d1": ("d2", False), "d2": ("d2", True), "d3": ("d4", False), "d4": ("d4", True), "d5": ("d4", False)}


def test_place_among_splitters(spark):
    cuts = [("", 1, 1), ("b", -5, 0), ("b", -5, 7), ("é", 0, 0)]
    places = [("", 0, 0), ("", 1, 1), ("a", 9, 9), ("b", -6, 9), ("b", -5, 6), ("b", -5, 7), ("c", 0, 0), ("é", 0, -1), ("é", 0, 0), ("日", 0, 0)]
    df = spark.createDataFrame(places, "head string, hash long, spread long").coalesce(1)
    got = [r[0] for r in df.select(exact_dedup_module.part_of(F.struct("head", "hash", "spread"), cuts)).collect()]
    assert got == [sum(c <= p for c in cuts) for p in places]
